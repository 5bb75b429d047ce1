"""Words of texts as integers, computed a batch at a time by vectorised string kernels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bracketed insertions of the record (interruptions, stage directions); longer brackets are taken as speech.
INSERTIONS = r"\[[^\[\]]{0,400}\]|\([^()]{0,400}\)"
_NOT_WORD = r"[^\p{L}\p{N}]+"


def normal_text(texts: pa.Array) -> pa.Array:
    """Lower case, without bracketed insertions, apostrophes and soft hyphens, one blank between words."""
    t = pc.utf8_lower(texts)
    for _ in range(2):  # brackets within brackets
        t = pc.replace_substring_regex(t, INSERTIONS, " ")
    t = pc.replace_substring_regex(t, "['’ʼ­]|-\\s*\n\\s*", "")
    return pc.utf8_trim(pc.replace_substring_regex(t, _NOT_WORD, " "), " ")


def flat_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a batch, one after the other, and where each text starts (with the end as last entry). Null counts as empty."""
    lists = pc.split_pattern(pc.fill_null(normal_text(texts), ""), " ")
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    return lists.values, lists.offsets.to_numpy()


def word_ids(words: pa.Array, vocabulary: pa.Array) -> np.ndarray:
    """Place of each word in the vocabulary, -1 outside it."""
    return pc.fill_null(pc.index_in(words, vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int32)
