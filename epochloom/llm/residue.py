"""Template residue, filler, error pages and script notices instead of (or inside) real content.

Two detectors:

* Unresolved *slots* (``{{ name }}``, ``%(name)s``, ``<PARTY>``, ``[INSERT DATE]``, ``[object Object]`` ...) are found wherever they
  stand in a text, by form alone.
* Messages are found by *templates*. Segments (lines and sentences) with at least one word of the message vocabulary go
  through a prefix tree of fixed depth: number of words, then the first words, then the most similar template of
  the leaf, whose differing words become wildcards. Each template is classified once, by weighing the words it keeps
  against signs of speech; its verdict goes to all documents with such a segment.

A segment without any word of the vocabulary can't reach the threshold by its own words, so it is left out; every phrase of
``WEIGHTS`` that counts more than 1 has a word of the vocabulary. Quoted words don't
weigh: a speaker may mention or complain about a message. The vocabulary is that of common messages in English, German, French, Spanish,
Italian, Portuguese and Dutch, with some Scandinavian and Polish; what speaks against residue are general signs of speech.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochloom.llm.leaks import slices
from epochloom.runtime import spill

_SLOT_WORD = r"(?:insert|name|speaker|member|minister|seat|constituency|party|group|title|text|date|body|paragraph|topic|amount|figure|placeholder|todo|tbc|tbd|tba|nom|orateur|groupe|texte|ins[ée]rer|titre|redner|rednerin|fraktion|redetext|einf[üu]gen|wahlkreis|datum|betrag|folgt)"
#: Forms of unresolved slots, case-sensitive.
SLOTS: tuple[str, ...] = (
    r"\{\{[^{}\n]{1,60}\}\}", r"\$\{[^{}\n]{1,60}\}", r"\$?\[\[[^\[\]\n]{1,60}\]\]", r"\{%[^{}\n]{1,80}%\}", r"<%[^<>\n]{1,80}%>",
    r"%\([A-Za-z_]\w*\)[sdfSDF]", r"%%[A-Za-z_][\w ]{1,40}%%", r"%[A-Z_][A-Z_ ]{1,40}%", r"@@[A-Za-z_]\w{1,40}@@", r"<<[A-Za-z][\w ]{0,40}>>",
    r"\{[A-Za-z]+(?:[_.][A-Za-z0-9]+)+\}", r"\{[A-Z]{2,}\}", r"(?<!\w)\{(?:[A-Za-z_]\w{1,40}|\d{1,3})\}", r"\[[A-Z][a-z]+(?:[A-Z][a-z]+)+\]", r"<[A-Z][A-Z_]*(?: [A-Z_]+){0,6}>", r"__[A-Z]+(?:_[A-Z]+)*__",
    r"(?i:\[object object\])", r"(?i:\bundefined\b(?:\W{1,3}\b(?:undefined|null|nan)\b)+)", r"(?i:\((?:null|undefined|nan)\))", r"#(?:REF|VALUE|NAME|DIV/0|N/A|NULL)[!?]?(?=\W|$)", r"<!--", r"(?i:</?noscript>)",
    rf"\[(?i:(?:insert|enter|add|fill in|your)\b[^\[\]\n]{{0,60}})\]", rf"\[(?i:[^\[\]\n]{{0,40}}\b(?:to be inserted|à insérer|einfügen|einzufügen|goes here|to follow|folgt))\]",
    rf"\[(?:(?i:{_SLOT_WORD})(?:[ '’_-]|(?i:de|du|la|l|des|der|die|das|of|the)\b)*){{1,5}}\](?=\s*(?:\(\[|\(\{{|:| :))", r"\[[A-Z][A-Z'’ ]{1,40}\]\s*\(\[[A-Z][A-Z'’ ]{1,40}\]\)",
    r"(?m:^\W*(?:undefined|null|NaN|None)(?:\W+(?:undefined|null|NaN|None))*\W*$)",
)
#: Weights of message vocabulary. A template with ``LEAST`` or more is residue.
WEIGHTS: tuple[tuple[int, str], ...] = (
    (30, r"lorem ipsum dolor|sed ut perspiciatis|excepteur sint occaecat|consectetur adipiscing|ut enim ad minim|duis aute irure|nemo enim ipsam|neque porro quisquam|at vero eos et accusamus|quis nostrud"),
    (4, r"blindtext|texte? de remplissage|faux[- ]texte|dummy text|placeholder text|sample (?:speech|text)|platzhalter(?:text)?|beispieltext|mustertext"),
    (4, r"replace this (?:paragraph|text|line|section)|\btest test\b|please ignore|(?:xxx+ ?){2,}|\b(?:tbc|tbd|tba)\b\W*(?:xxx+|$)|asdf|(?:text|speech|transcript) of (?:item|speech|column)\b.* to follow"),
    (4, r"javascript (?:is|must be|needs to be|has been|ist)|(?:enable|activate|allow|turn on|switch on|requires?|needs?|activez|activer|besoin de|aktivieren sie|ben[öo]tigt|erfordert) (?:javascript|scripts)|javascript (?:aktivieren|activ[ée])"),
    (4, r"checking your browser|your browser (?:does not|doesn't|runs?|is|must|has)|in your browser|ihr browser|votre navigateur|(?:scripts?|javascript) (?:for|on) this site|(?:drawn|rendered|built) by scripts"),
    (4, r"internal server error|interner serverfehler|erreur interne|bad gateway|gateway time-?out|service (?:temporarily )?unavailable|http (?:error|status)|error establishing|database connection|datenbankverbindung|on this server|sur ce serveur|auf diesem server"),
    (4, r"nullpointerexception|exception in thread|stack ?trace|traceback|segmentation fault|unhandled exception|fatal error|syntax error|upstream (?:did|timed|server|request)|rate limit"),
    (4, r"too many requests|session (?:has )?(?:timed out|expired)|session (?:a|est) expir|sitzung ist abgelaufen|(?:sign|log) in (?:again|to continue)|reconnectez-vous|melden sie sich (?:erneut|wieder)|page you (?:were|are) looking for|no longer exists|encountered an unexpected"),
    (4, r"(?:^|[^\w])(?:error|erreur|fehler) (?:4\d\d|5\d\d)\W|^\W*(?:4\d\d|5\d\d) (?:not found|bad gateway|forbidden|internal|service|gateway|unauthori[sz]ed|error)|template\W+(?:\S+ )?is missing"),
    (4, r"(?:something|anything) went wrong|algo (?:salió|ha ido|deu|correu) m[aá]l|etwas (?:ist )?schief ?ge|une erreur (?:s'est produite|est survenue|inattendue)|er is iets mis|qualcosa è andato storto|(?:se ha producido|ha ocurrido) un error|si è verificato un errore|ocorreu um erro|er is een fout opgetreden|(?:ein (?:unerwarteter )?fehler (?:ist )?aufgetreten)|an (?:unexpected |unknown )?error (?:has )?occurred|ett fel (?:har )?uppstått|der opstod en fejl|wystąpił błąd"),
    (4, r"scheduled maintenance|(?:site|website|page|system|server|service|application)\b.{0,30}\b(?:down|offline|closed|unavailable|under)\b.{0,20}\bmaintenance|(?:en|bajo) mantenimiento|en (?:cours de )?maintenance|wartungsarbeiten|wegen wartung|in manutenzione|em manutenção|in onderhoud|wegens onderhoud"),
    (4, r"(?:verify|confirm|prove) (?:that )?you(?:'re| are) (?:a )?(?:not a robot|human)|captcha|(?:i'm|i am|you are) not a robot|no soy un robot|je ne suis pas un robot|kein roboter|non sono un robot|geen robot"),
    (4, r"\b(?:coming soon|under construction|próximamente|en construcción|bientôt disponible|en construction|demnächst verfügbar|im aufbau|binnenkort beschikbaar|prossimamente|in costruzione|em breve|em construção)\W*$"),
    (4, r"(?:habilit\w*|activ\w*|permit\w*|abilit\w*|attiv\w*|ativ\w*|schakel\w*|ingeschakeld|aktiver\w*|necesita|richiede|requer|vereist|ondersteunt|supporta|soporta|unterstützt)\b.{0,30}\bjavascript|javascript\b.{0,30}\b(?:desactivad|deshabilitad|désactivé|deaktiviert|disattivat|disabilitat|desativad|uitgeschakeld|inaktiver|disabled|turned off|blocked)"),
    (4, r"(?:tu|su|seu|uw|je|il tuo|o seu) (?:navegador|browser)\b|\b(?:navegador|navigatore)\b.{0,40}\b(?:no|non|não)\b|cookies? (?:must|need to|are|is|has to|muss|müssen|doivent|deben)"),
    (4, r"^\W*(?:\S+ ){0,5}(?:error|erreur|fehler|errore|erro|fout|fejl|fel|błąd|virhe|chyba|hiba|status|code) ?(?:http )?[45]\d\d\b|\b[45]\d\d (?:<\*> )?(?:error|nginx|apache|forbidden|bad request|página|pagina)|\bnginx\b|\bapache tomcat\b|cloudflare|\bray id\b|err_[a-z_]+|dns_probe|connection (?:timed out|refused|reset by)"),
    (4, r"(?:página|pagina|documento?|archivo|pagina's?|sida|sidan|side|siden|strona|stránka)\b.{0,40}\b(?:no (?:se )?(?:ha |ha sido |fue )?encontr|non (?:è stat[oa] )?trovat|não (?:foi )?encontrad|niet gevonden|hittades inte|ikke fundet|nie znaleziono|nenalezena)"),
    (4, r"(?:sesión|sessione|sessão|sessie)\b.{0,20}\b(?:caducad|expirad|ha expirado|scadut|è scaduta|expirou|verlopen)|(?:acceso denegado|accesso negato|acesso negado|toegang geweigerd)|(?:servicio|servizio|serviço|dienst)\b.{0,20}\b(?:no disponible|non disponibile|indisponível|niet beschikbaar|temporalmente|temporaneamente|temporariamente|tijdelijk)"),
    (4, r"(?:refresh|reload) (?:the|this|your) (?:page|browser)|this (?:page|site|content) (?:isn't|is not|can't be|cannot be|is no longer) (?:working|available|reached|displayed|shown)|(?:contenido no disponible|contenu (?:non |in)disponible|inhalt nicht verfügbar|contenuto non disponibile|conteúdo (?:não disponível|indisponível)|inhoud niet beschikbaar)|you have been blocked|access to this (?:page|site) (?:has been|is) (?:denied|blocked)|erreur interne du serveur|error interno del servidor|errore interno del server|erro interno do servidor|interne serverfout"),
    (3, r"could not be (?:loaded|displayed|found|retrieved)|cannot load|failed to load|access denied|acc[èe]s refus[ée]|zugriff verweigert|don't have permission|do not have permission|keine berechtigung|permission to (?:view|access)"),
    (3, r"est introuvable|page introuvable|seite (?:wurde )?nicht gefunden|(?:protokoll|dokument)\b.* wurde nicht gefunden|versuchen sie es|r[ée]essayez|try again (?:in|later)"),
    (2, r"javascript|noscript|\bscripts?\b|\bbrowser\b|\bserver\b|serverfehler|\bhttps?\b|nicht gefunden|not found|introuvable|\breload\b|\bunavailable\b|\bexception\b|\bplaceholder\b"),
    (1, r"\berror\b|\berreur\b|\bfehler\b|\bplease\b|\bbitte\b|\byour?\b|\bsession\b|\bpage\b|\bload(?:ing|ed)?\b|\bcolumn\b|\brequest(?:ed|s)?\b|\btranscript\b|\bto follow\b|\btbc\b|\bdisplay\b|\bafficher\b|\banzuzeigen\b"),
    # what tells speech: somebody speaks, reports or argues; and amendments to wording
    (-5, r"\b(?:i|we|my|our|us|nobody|minister|ministre|minister's|constituents?|honou?rable|hon|told|says?|said|answered|ich|wir|uns|je|nous)\b"),
    (-10, r"\b(?:as if|ago|since|for (?:years|months|weeks)|wrote|writes|reported|replied|asked|complained|explained|argued|claimed|they|he|she|schrieb|sagte|berichtete|antwortete|fragte|sie sagten|a écrit|a répondu|a dit|a déclaré|ils|dijo|escribió|respondió|ha detto|ha scritto|disse|escreveu|schreef|zei|antwoordde)\b"),
    (-5, r"\b(?:leave out|insert the following|and insert|amendment|clause|schedule)\b"),
)
LEAST = 3
#: One word of the vocabulary; a segment without any can't reach ``LEAST``. Also used to find documents worth a look.
VOCABULARY = (
    r"lorem ipsum|perspiciatis|excepteur|consectetur|ut enim ad|duis aute|nemo enim|neque porro|vero eos|quis nostrud|blindtext|remplissage|faux[- ]texte|dummy|placeholder|sample (?:speech|text)|platzhalter|beispieltext|mustertext"
    r"|replace this|\btest test\b|please ignore|xxx|\btb[cda]\b|asdf|to follow|javascript|script|browser|navigateur|server|serveur|gateway|unavailable|http|establishing|database|datenbank|exception|trace|fault|fatal|syntax error|upstream|rate limit"
    r"|too many|session|ist abgelaufen|sign in|log in|reconnectez|melden sie|looking for|no longer exists|unexpected|error|erreur [45]|erreur interne|^erreur|fehler|not found|template|could not be|cannot load|to load|denied|refus[ée]|verweigert|permission|berechtigung|introuvable|nicht gefunden|versuchen sie|essayez|try again|reload"
    r"|forbidden|unauthori[sz]ed|[45]\d\d\W+(?:internal|service|nginx|página|pagina|bad)"
    r"|went wrong|algo (?:sali|ha ido|deu|correu)|schief|une erreur|iets mis|andato storto|fout|ocorreu um|occurred|ocurrido|producido|ett fel|fejl|błąd|virhe|chyba|hiba|maintenance|mantenimiento|wartung|manutenzione|manutenção|onderhoud|under construction|captcha|robot|you(?:'re|’re| are) (?:a )?human"
    r"|coming soon|próximamente|en construc|bientôt disponible|demnächst|im aufbau|binnenkort|prossimamente|in costruzione|em breve|em construção|navegador|navigatore|cookie|nginx|apache|cloudflare|ray id|err_|dns_probe|connection (?:timed|refused|reset)"
    r"|(?:no|se|ha|sido|fue) encontr|trovat|não (?:foi )?encontrad|niet gevonden|hittades inte|ikke fundet|nie znaleziono|nenalezena|sesión|sessione|sessão|sessie|denegado|negato|acesso negado|geweigerd|no disponible|disponibile|indispon|beschikbaar|(?:refresh|reload) (?:the|this|your)|this (?:page|site|content)|verfügbar|have been blocked|access to this|non disponible|não disponível|erro interno|temporalmente|temporaneamente|temporariamente|tijdelijk|\b(?:erro|fel|code|status) ?[45]\d\d"
)
_SLOT = re.compile("|".join(SLOTS))
_MACHINE_SLOT = re.compile("|".join(SLOTS[:10]))
_SLOT_HINT = (
    r"[{}<>%$@#]|\[[A-Z][a-z]+[A-Z]|\[\[|\[(?i:object)|(?i:undefined|\((?:null|nan)\))|(?m:^\W*(?:undefined|null|NaN|None)\b)|__"
    r"|\[[^\[\]\n]{0,60}(?i:insert|enter|add|fill|your|goes here|follow|name|speaker|member|minister|seat|constituency|party|group|title|text|date|body|paragraph|topic|amount|figure|placeholder|todo|tb[cda]|nom|ins[ée]rer|titre|redner|fraktion|einf|einzu|wahlkreis|datum|betrag|folgt)"
)
_VOC = re.compile(VOCABULARY)
_WEIGHTS = [(w, re.compile(p)) for w, p in WEIGHTS]
_CUT = re.compile(r"(?<=[.!?;])\s+|\n+")
_QUOTED = re.compile(r"(?<![^\s(\[])(?:'[^'\n]{2,90}'|\"[^\"\n]{2,90}\"|“[^”\n]{2,90}”|‘[^’\n]{2,90}’|«[^»\n]{2,90}»)(?![^\W_])")
_INSERTION = re.compile(r"\[[^\[\]]{0,200}\]|\([^()]{0,200}\)")


def has_slot(text: str) -> bool:
    """Whether a text holds an unresolved slot outside quotes; an interruption that the record quotes is no quote."""
    if _SLOT.search(_QUOTED.sub(" ", text)):
        return True
    return any(_MACHINE_SLOT.search(m.group(0)) for m in _INSERTION.finditer(text))


def segments(text: str) -> list[str]:
    """Lines and sentences with vocabulary, as normal words: lower case, quoted words and variable parts masked."""
    out = []
    for s in _CUT.split(_QUOTED.sub(" <*> ", text)):
        low = s.lower().replace("’", "'")
        if _VOC.search(low):
            words = []
            for w in low.split():
                core = re.sub(r"(?<=[a-z]{3})/[\d.]+", "", w.strip(".,:;!?()[]\"'…-–—"))
                digits = any(c.isdigit() for c in core)
                words.append(core if not digits or re.fullmatch(r"[45]\d\d", core) else "<*>")
            out.append(" ".join(w for w in words if w))
    return out


def weigh(template: str) -> int:
    """Evidence of a template for residue, against it for speech; a vocabulary line counts once."""
    bare = template.replace("<*>", " ")
    bare = re.sub(r"\s+", " ", bare).strip()
    return sum(w for w, p in _WEIGHTS if p.search(bare))


class PrefixTree:
    """Templates of segments of one leaf: same number of words and same first words."""

    def __init__(self, similarity: float = 0.6):
        self.similarity, self.templates = similarity, []
        self._ids, self._words = {}, np.zeros((0, 0), np.int32)  # templates as numbers of words, to compare with all at once

    def add(self, words: list[str]) -> int:
        """Number of the template that takes the segment; a new one if none is similar enough."""
        n, ids = len(self.templates), np.array([self._ids.setdefault(w, len(self._ids)) for w in words], np.int32)
        if n:
            same = (self._words[:n] == ids).sum(axis=1)
            best = int(same.argmax())  # the first of equal ones
            if same[best] >= self.similarity * len(words):
                t = self.templates[best]
                for j in np.flatnonzero(self._words[best] != ids):
                    t[j] = "<*>"
                    self._words[best, j] = self._ids.setdefault("<*>", len(self._ids))
                return best
        if n == len(self._words):
            grown = np.zeros((max(16, 2 * n), len(words)), np.int32)
            grown[:n] = self._words[:n] if n else 0
            self._words = grown
        self._words[n] = ids
        self.templates.append(list(words))
        return n


def mine(found: list[str], similarity: float = 0.6) -> list[tuple[str, str]]:
    """(segment, template) of the segments of one leaf, in an order that doesn't depend on how they came."""
    tree = PrefixTree(similarity)
    found = sorted(set(found))
    at = [tree.add(s.split(" ")) for s in found]
    return [(s, " ".join(tree.templates[i])) for s, i in zip(found, at)]


def find_residue(documents: DataFrame, *, key: str, text: str, depth: int = 3) -> DataFrame:
    """Distinct ``key`` of documents that are, or hold, residue.

    Null and blank texts are none. A leaf is mined whole by one task, from its different segments only: templates depend on
    which segments share a tree, so a split would change verdicts.
    Extra columns are ignored.
    """
    kind = documents.schema[key].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 8_000_000):
                t = part.column(1)
                worth = pc.or_(pc.match_substring_regex(t, VOCABULARY, ignore_case=True), pc.match_substring_regex(t, _SLOT_HINT))
                part = part.filter(pc.fill_null(worth, False))
                at, seg = [], []
                for i, x in enumerate(part.column(1).to_pylist()):
                    if has_slot(x):
                        at.append(i)
                        seg.append(None)
                        continue
                    for s in dict.fromkeys(segments(x)):
                        at.append(i)
                        seg.append(s)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), pa.array(seg, pa.string())], ["key", "segment"])

    rows = documents.select(documents[key].alias("key"), documents[text].alias("text")).where("text is not null and key is not null")
    found = spill(rows.mapInArrow(scan, f"key {kind}, segment string"))
    words = F.split("segment", " ")
    leaf = F.concat_ws(" ", F.size(words).cast("string"), F.slice(words, 1, depth - 1))
    distinct = found.where("segment is not null").select(leaf.alias("leaf"), "segment").distinct()

    def classify(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs, verdicts = mine(pdf["segment"].tolist()), {}
        for _, t in pairs:
            if t not in verdicts:
                verdicts[t] = weigh(t)
        return pd.DataFrame({"segment": [s for s, _ in pairs], "template": [t for _, t in pairs], "weight": [verdicts[t] for _, t in pairs]})

    verdicts = distinct.groupBy("leaf").applyInPandas(classify, "segment string, template string, weight int")
    bad = spill(verdicts.where(F.col("weight") >= LEAST).select("segment"))
    told = found.join(bad, "segment", "left_semi").select("key")
    return found.where("segment is null").select("key").unionByName(told).distinct().withColumnRenamed("key", key)
