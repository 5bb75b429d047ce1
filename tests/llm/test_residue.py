import re

import numpy as np
import pytest

from epochloom.llm.residue import LEAST, WEIGHTS, find_residue, has_slot, mine, segments, weigh

RESIDUE = [
    "{{ speaker.name }} ({{ party }}): I rise.", "${member} - ${item}", "%SPEAKER% said so.", "%%BODY%%", "The figure was %(amount)s crowns.", "@@PARA_7@@", "<<Name>> spoke.", "<SPEAKER NAME>, <PARTY>: text",
    "[INSERT FIGURE FROM TABLE 3]", "[MEMBER NAME] ([SEAT]): hello", "[NOM DE L'ORATEUR] ([GROUPE]) : [texte 9 à insérer]", "[REDNER EINFÜGEN] ([FRAKTION]): [Redetext 4 folgt]", "The {ITEM_TITLE} was debated.", "a [object Object] b",
    "The #REF! store.", "undefined (null): undefined\nnull", "$[[vote.ayes]] to $[[vote.noes]]", "<noscript>x</noscript>",
    "undefined undefined (null): I declare an interest.", "UNDEFINED (NULL): UNDEFINED\nNULL", "He said so. [HON. MEMBERS: \"Hear, {{ amount_37 }} hear!\"] Quite.", "the %(MINISTER_NAME)S spoke",
    "Lorem ipsum dolor sit amet, consectetur.", "I must say that we Sed ut perspiciatis unde omnis iste natus", "404 Not Found\nThe requested transcript was not found on this server.", "HTTP Error 503. The service is unavailable.",
    "INTERNAL SERVER ERROR\nThe archive encountered an unexpected condition.", "Error establishing a database connection", "Too many requests. Slow down.", "Your session has timed out. Please sign in again to continue.",
    "You need to enable JavaScript to read the sitting.", "Checking your browser before you enter.", "Bitte aktivieren Sie JavaScript, um das Protokoll anzuzeigen.", "Votre session a expiré.", "Erreur 404 - la page est introuvable.",
    "Fehler 404: Das Protokoll vom 2016 wurde nicht gefunden.", "Dies ist ein Blindtext.", "Sample speech. Replace this paragraph with the words spoken.", "test test test please ignore", "Text of item 13 to follow. TBC. XXXX XXXX",
    "Access Denied\nYou don't have permission to view column 4 on this server.", "A long speech. We agreed. Error 500: the remaining paragraphs could not be loaded.",
]
SPEECH = [
    "The booking service in Morstead answered with error 503 for 8 nights running, and the ferry sailed empty.", "The Minister's reply might as well have been lorem ipsum, for all the use it was.",
    "'The service is unavailable': that recorded message is all Lancombe has heard since April.", "The formula in clause 59 reads A{1} + B{2}, and I defy anyone to explain it.",
    "When somebody tried to apply, the portal showed only the words '404 not found', and nobody rang back.", "The template for the Memwick lease had a blank where the rent should be, and they signed it.",
    "Access was denied to Girn Drayrcaeck at the clinic door, and I call that a disgrace.", "I hold a letter which still begins 'Dear [name]'; that is how they treat us.",
    "Pensioners were told to enable JavaScript, as if that were an answer to a cold kitchen.", "Page 38, line 41, leave out 'may' and insert 'must, within 38 days'.", "In the Schedule, insert the following words after paragraph 7(b): 'and any quay'.",
    "The figure is to be confirmed, I am told.", "Somebody quoted 'Dear {{name}}' to me.", "The border was left undefined, and the vote null and void.", "[Interruption.] [HON. MEMBERS: \"Hear, hear!\"] [Name withheld by order of the Chair] [sic] [Translation] (Laughter)", "He paid 5% of the $20 fee & left; see <the record>.", None, "", "   \n",
    "plain words " * 50_000,
]


#: Messages and speech in several languages that aren't in the test tables; not all must be found.
OTHERS = [
    "Oops! Something went wrong.", "This site is down for maintenance", "Please verify you are a human", "Content coming soon.", "502 / nginx/1.18.0", "Hello [FirstName], your order {0} has shipped.", "Hi {name}", "Lo sentimos, la página no se ha encontrado.",
    "Su sesión ha caducado.", "Debe habilitar JavaScript para ver este contenido.", "De pagina kon niet worden geladen: fout 500", "Uw browser ondersteunt geen JavaScript.", "Accesso negato. Non hai i permessi.", "Errore 404: pagina non trovata", "Servizio temporaneamente non disponibile.",
    "A página solicitada não foi encontrada.", "Ein unerwarteter Fehler ist aufgetreten. Laden Sie die Seite neu.", "Cette page est en construction", "Your connection timed out. Refresh the page.", "Dear {{customer}}, thank you.", "Wegen Wartungsarbeiten ist diese Seite nicht erreichbar.", "Sidan hittades inte",
    "Ha ocurrido un error inesperado", "We'll be right back. Scheduled maintenance in progress.", "Zgoda na pliki cookies jest wymagana", "Just a moment...",
]
OTHERS_SPEECH = [
    "A server error 500 was reported: the service is unavailable, so the clerk wrote to every member.", "He wrote that the page was not found and that the session had expired.", "The bridge at Wellcombe has been under maintenance for years.", "They asked for the robot to be moved from the quay.", "The new line is coming soon enough, said the mayor.",
    "La ministre a répondu que le serveur était en panne.", "The committee found an error in column 4 of the return.", "Der Abgeordnete sagte, die Seite sei nicht gefunden worden.", "Please accept my apology; the request was unavailable to us.", "The cookie factory closed two years ago.",
]


def test_other_messages_and_speech(spark):
    df = spark.createDataFrame(list(enumerate(OTHERS + OTHERS_SPEECH)), "doc_id long, text string")
    got = {r.doc_id for r in find_residue(df, key="doc_id", text="text").collect()}
    missed = [OTHERS[k] for k in range(len(OTHERS)) if k not in got]
    wrong = [OTHERS_SPEECH[k - len(OTHERS)] for k in got if k >= len(OTHERS)]
    assert len(missed) <= 0.2 * len(OTHERS) and not wrong, (missed, wrong)


@pytest.mark.parametrize("depth", [2, 3])
def test_find_residue(spark, depth):
    rows = [(k, t, "clash") for k, t in enumerate(RESIDUE + SPEECH)] + [(None, RESIDUE[0], "c"), (0, RESIDUE[0], "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, segment string")
    got = sorted(r.doc_id for r in find_residue(df.repartition(3), key="doc_id", text="text", depth=depth).collect())
    assert got == list(range(len(RESIDUE)))


def test_leaf_split_by_hash_gives_the_same(spark):
    rows = [(k, f"You need to enable JavaScript to read the {chr(97 + k % 26)}{chr(97 + k // 26)}x sitting.") for k in range(200)] + [(500 + k, f"The page of the {chr(97 + k % 26)}x book was read.") for k in range(26)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in find_residue(df, key="doc_id", text="text").collect()) == list(range(200))
    assert find_residue(df.limit(0), key="doc_id", text="text").count() == 0


def test_verdicts_do_not_depend_on_the_size_of_a_part(spark):
    # the whole leaf shares one template, in which the weighted words are wildcards; a part with one segment would keep them
    rows = list(enumerate(f"The harbour board wrote that the gate was {x} at the north quay." for x in ("javascript nullpointerexception", "fatal traceback", "forbidden today", "not found", "no longer exists")))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [sorted(r.doc_id for r in find_residue(df.repartition(k), key="doc_id", text="text").collect()) for k in (1, 5)]
    assert got[0] == got[1] and len(got[1]) < len(rows)


def slowly(found, similarity=0.6):
    """The templates by comparing word by word."""
    templates, at = [], []
    for s in sorted(set(found)):
        words = s.split(" ")
        same = [sum(a == b for a, b in zip(t, words)) for t in templates]
        best = same.index(max(same)) if same else -1
        if same and same[best] >= similarity * len(words):
            templates[best] = [a if a == b else "<*>" for a, b in zip(templates[best], words)]
        else:
            best = len(templates)
            templates.append(words)
        at.append(best)
    return [(s, " ".join(templates[i])) for s, i in zip(sorted(set(found)), at)]


def test_mining_against_word_by_word():
    rng = np.random.default_rng(1)
    found = [" ".join(rng.choice(["a", "b", "c", "<*>"], 5)) for _ in range(400)]
    assert mine(found) == slowly(found) and len({t for _, t in mine(found)}) > 20


def test_templates_merge_what_varies():
    found = [f"your session for {x} has timed out" for x in ("aa", "bb", "cc")]
    assert {t for _, t in mine(found)} == {"your session for <*> has timed out"}
    assert mine([]) == [] and weigh("<*> <*>") == 0


def test_forms():
    assert not has_slot("Dear '[name]'") and has_slot("Dear {{name}}") and segments("Nothing of note.\nNor here.") == []


def phrases(tree):
    """Texts that a parsed pattern matches: all its branches and optional parts."""
    out = [""]
    for op, arg in tree:
        op = str(op)
        if op == "LITERAL":
            options = [chr(arg)]
        elif op == "BRANCH":
            options = [p for branch in arg[1] for p in phrases(branch)]
        elif op == "SUBPATTERN":
            options = phrases(arg[3])
        elif op == "MAX_REPEAT":
            options = [p * arg[0] for p in phrases(arg[2])] + ([] if arg[0] else phrases(arg[2]))
        elif op == "IN":
            options = [chr(a) for o, a in arg if str(o) == "LITERAL"] or ["4" if any("CATEGORY_DIGIT" in str(a) for _, a in arg) else " "]
        else:
            assert op in ("AT", "ANY"), op
            options = ["" if op == "AT" else "x"]
        out = [a + b for a in out for b in options]
    return out


def test_every_weighted_phrase_alone_passes_the_prefilter(spark):
    # phrases of weight 1 are one line of WEIGHTS, so they can't reach the threshold by themselves
    assert sum(w for w, _ in WEIGHTS if w == 1) < LEAST
    every = sorted({" ".join(p.split()) for w, pattern in WEIGHTS if w > 1 for p in phrases(re._parser.parse(pattern))})
    assert len(every) > 200 and {"444 forbidden", "lorem ipsum dolor"} <= set(every)
    assert [p for p in every if not segments(p)] == []
    lines = ["403 Forbidden", "401 Unauthorized", "401: Unauthorised", "500 Internal", "503 Service"]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert {r.doc_id for r in find_residue(df, key="doc_id", text="text").collect()} == set(range(len(lines)))
