import math

import pytest

from sparkloom.llm.endings import fit_ends, last_part, shape
from sparkloom.llm.languages import LEAST_WORDS, fit_languages, prose_words
from sparkloom.llm.lengths import length_limits, upper_tail
from sparkloom.llm.pairs import broken_pairs, defect, is_empty
from sparkloom.llm.refusals import is_refusal
from sparkloom.llm.structure import endings, open_at_end, stops_inside
from sparkloom.llm.truncation import truncated_texts, truncation_by_source

QUESTION = "Explain what the routine at $7E1234 does when the timer wraps.\nLDA #$12\nSTA $2100"
# Sentences in several languages, of which tests fit their profiles.
SENTENCES = {
    "en": ["The routine stores the value in the table and returns.", "It is read when the timer wraps and then it is cleared.", "What does this code do to the flag before the next frame?", "Each entry of the list holds the bytes that were written.", "Explain how the counter is used by the loop and why."],
    "de": ["Die Routine schreibt den Wert in die Tabelle und kehrt zurück.", "Der Zähler wird gelesen, wenn die Zeit abläuft, und dann gelöscht.", "Was macht dieser Abschnitt mit dem Register vor dem Bild?", "Jeder Eintrag der Liste enthält die Bytes, die geschrieben wurden.", "Erkläre, wie die Schleife von oben herunter zählt und warum sie nicht füllt."],
    "es": ["La rutina guarda el valor en la tabla y vuelve.", "El contador se lee cuando termina el tiempo y luego se borra.", "Qué hace este código con el registro antes del cuadro?", "Cada entrada de la lista contiene los bytes que se escribieron.", "Explica cómo el bucle usa el contador y por qué."],
}


@pytest.fixture(scope="module")
def languages(spark):
    rows = [(k, text + " " + text.lower(), lang + mark) for k, (lang, mark) in enumerate((l, m) for l in SENTENCES for m in ("", "-XX", " ")) for text in SENTENCES[lang] * 3]
    rows += [(1000, "これは表に書かれています。" * 50, "ja"), (1001, None, "en"), (1002, "no label at all", None), (1003, "odd label", "und")]
    return fit_languages(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))


GOOD = "The routine stores the counter in $2100 and returns. It never touches the other register."


@pytest.mark.parametrize(
    "text",
    ["Done.", "XBA", "RTS", "Use XBA instead", "76 cycles", "No.", "", None, "   ", "LDA #$10\nSTA $2100\nRTS", "Text here.\n```\nLDA $10", "¿Qué?", "```asm\nNOP\n```", "- one thing.\n- another thing.", "He said “no”.", "(see the table at $10.)", "測ります。"],
)
def test_complete(text):
    assert (stops_inside(text) is None) == (text != "Text here.\n```\nLDA $10")


@pytest.mark.parametrize(
    "text,kind",
    [
        ("The counter is stored in the low by", "sentence"),
        ("The counter is stored...", "mark"),
        ("The counter is stored in the lo [truncated]", "mark"),
        ("Steps are these.\n\n1. Load the value.\n2.", "list_item"),
        ("Steps are these.\n\n1. Load the val", "list_item"),
        ("```asm\nLDA $10\nSTA", "code_block"),
        ("LDA #$10\nSTA $2100\nLDA $7E", "code_block"),
        ("Both registers, one of which", "sentence"),
        ("Inline ```asm\nLDA $10\n``` and then the nex", "sentence"),
    ],
)
def test_cut(text, kind):
    assert stops_inside(text) == kind


@pytest.mark.parametrize(
    "text,kind",
    [
        ("LDA.l CheckMoth29,X\nSTA $7E76C4\nASL A\nTAX\nJMP (UpdateGate_Even,", "code_block"),
        ("TAX\nJML [Vector", "code_block"),
        ("The flag is set (see the table.", "sentence"),
        ("He wrote “it is set. The rest is clear.", "sentence"),
        ('He wrote "it is set. The rest is clear.', "sentence"),
        ("Steps are these.\n\n- Load the value (from the table.", "list_item"),
        ("<b>One</b> is set. <b>Two is clear.", "sentence"),
        ("The table (see above) is read.\nIt holds [the flag.", "sentence"),
    ],
)
def test_cut_inside_an_open_mark(text, kind):
    assert stops_inside(text) == kind and defect(QUESTION, text) == "truncated"


@pytest.mark.parametrize(
    "text",
    ["The range is [0, 256).", "The range is (0, 255].", "It fits a 3.5\" disk.", "Write `(` before the name.", "It compares with '(' first.", "„So ist es”, steht dort.", "Das »Register« ist leer.", '"One.\n\nTwo."', "LDA $10 ; (old\nSTA $2100\nRTS", "He said \"set $10\" and left.", "<ul><li>One.<li>Two.</li></ul>", "a) One is set. b) Two is clear.", "See (the table [one]).", "Press <b> twice.", "TAX\nJMP (Vector,X)"],
)
def test_closed_marks_are_complete(text):
    assert stops_inside(text) is None


def test_quotations_over_paragraphs():
    assert open_at_end("«Un.\n\nDeux. »") == open_at_end("„Eins.\n\nZwei.“") == []


def test_strict_endings():
    assert stops_inside("See hud_core.") is None and stops_inside("See hud_core.", strict=True) == "word"
    assert stops_inside("TAX\nJMP (Foo,X)") is None and stops_inside("TAX\nJMP (Foo,X)", strict=True) == "code_block"
    assert stops_inside("TAX\nRTS", strict=True) is None and stops_inside("It is done.", strict=True) is None


def test_strict_endings_decide_at_a_limit(spark):
    assert stops_inside("Use XBA instead", strict=True) is None
    limit = 41
    rows = [(k, f"It is whole.{'x' * (k % 60)}.") for k in range(240)] + [(1000 + k, "b" * (limit - 1) + ".") for k in range(200)]
    listing = "TAX\n" * ((limit - 8) // 4)
    listing += "JMP " + "R" * (limit - len(listing) - 4)
    rows += [(3000, listing), (3001, listing + "R")]
    df = spark.createDataFrame([(i, "m", text) for i, text in rows], "result_id bigint, model string, response string")
    got = {r["result_id"]: r for r in truncated_texts(df).collect()}
    assert got[3000]["at_limit"] and got[3000]["inside"] == "code_block" and not got[3001]["truncated"] and not got[1000]["truncated"]


def test_pushdown_parser():
    assert open_at_end("a (b [c") == ["(", "["]
    assert open_at_end("a (b [c])") == []
    assert open_at_end("```\n( [\n```") == []
    assert open_at_end("x\n```py\n(") == ["fence"]
    assert open_at_end("(a\n\nb") == []
    assert open_at_end("<div> <b>x</b> and </b>") == []


@pytest.mark.parametrize(
    "question,answer,want",
    [
        (QUESTION, GOOD, None),
        (QUESTION, None, "empty"),
        (QUESTION, "​ ﻿", "empty"),
        (QUESTION, "N/A", "empty"),
        (QUESTION, "```asm\n\n```", "empty"),
        (QUESTION, "(no output)", "empty"),
        (QUESTION, "Never.", None),
        (QUESTION, "> " + QUESTION.replace("\n", "\n> "), "echo"),
        (QUESTION, "Question: " + QUESTION.lower(), "echo"),
        (QUESTION, "You asked: " + QUESTION, "echo"),
        (QUESTION, QUESTION + "\n" + QUESTION, "echo"),
        (QUESTION, "### Instruction\n" + QUESTION + "\n\n### Response\n", "echo"),
        (QUESTION, QUESTION.split("\n")[0] + " Never.", None),
        (QUESTION, "$2100", None),
        (QUESTION, "You asked what the routine at $7E1234 does when the timer wraps. It clears the flag and returns to the caller at once.", None),
        (QUESTION, "I'm sorry, but I can't help with that. Try asking about something else.", "refusal"),
        (QUESTION, "Leider kann ich dabei nicht helfen.", "refusal"),
        (QUESTION, "I can't stress enough that $2100 is write only. Set it once.", None),
        (QUESTION, "Sorry for the short answer, the flag is clear.", None),
        (QUESTION, "The value is shifted by one and stor", "truncated"),
        (QUESTION, "Die Schleife zählt von 10 herunter und füllt das Register, wenn der Zähler nicht null ist.", "other_language"),
        (QUESTION, "The old note called it “die Schleife ist nicht für den Zähler” and left it so for the table.", None),
        ("Was macht dieser Abschnitt mit $10?", "It stores the value in the table and then returns to the caller.", "other_language"),
        (QUESTION, "LDA #$10 ; die Schleife ist nicht leer\nSTA $2100 ; und der Zähler wird\nRTS", None),
        (None, "Die Schleife zählt von 10 herunter und füllt das Register.", None),
        ("", GOOD, None),
    ],
)
def test_defects(question, answer, want, languages):
    assert defect(question, answer, languages=languages) == want


def test_length_of_a_refusal_does_not_matter():
    assert is_refusal("I am sorry, but I cannot help with that. " * 50)
    assert is_refusal("Es tut mir leid, ich kann dazu nichts sagen. " * 50)
    assert not is_refusal("I cannot help with that. But here is what the loop does in general, it reads each entry of the list and clears the flag that it finds there.")
    assert not is_refusal("The value cannot be written. We pass it on to the next routine.")


def test_stand_ins_of_any_width():
    assert is_empty("-" * 40 + " none " + "-" * 40) and is_empty("[ no   output ]") and is_empty(None) and is_empty("```asm\n```")
    assert not is_empty("none left") and not is_empty("asm")


def test_a_cut_mark_of_any_width():
    assert stops_inside("The counter is stored" + "." * 80) == "mark"
    assert stops_inside("The counter is stored [[[          truncated           ]]]") == "mark"


def test_long_refusals():
    assert defect(QUESTION, "I'm sorry, I can't help with that." + " " * 700) == "refusal"
    assert defect(QUESTION, " ".join(["I can't help with that.", "I am unable to answer this."] * 15)) == "refusal"
    assert defect(QUESTION, "I can't help with that. " + GOOD * 10) is None


def test_language_by_script_and_profiles(languages):
    assert languages.names and "ja" not in languages.names
    assert languages.tell("これは表に書かれています。") == "ja"
    assert languages.tell("The value is stored in the table and then it is read") == "en"
    assert languages.tell("Der Wert wird in die Tabelle geschrieben und dann gelöscht") == "de"
    assert languages.tell("LDA #$10\nSTA $2100") is None and languages.tell(None) is None
    assert languages.plausible("") == () and len(languages.plausible("xyzzy")) != 1
    assert not languages.differs((), "Die Routine schreibt den Wert.") and not languages.differs(("en",), "LDA $10")


def test_languages_of_an_empty_table(spark):
    empty = fit_languages(spark.createDataFrame([], "doc_id bigint, text string, lang string"))
    assert empty.names == [] and empty.tell("The value is stored") is None and empty.tell("これは表に書かれています。") == "ja"


SUBJECTS = ["the loop", "the counter", "our queue", "this handler", "the mask", "the reader"]
DEEDS = ["clears the lower byte", "copies both rows into the table", "waits for the next frame", "skips 12 entries of FlushGate_Left", "reads $7E1234 every second frame"]


@pytest.fixture(scope="module")
def ends(spark):
    texts = [f"{a.capitalize()} {b}. Then {c} {d}." for a in SUBJECTS for b in DEEDS for c in SUBJECTS for d in DEEDS]
    held_out = [t for k, t in enumerate(texts) if k % 5]
    return fit_ends(spark.createDataFrame(list(enumerate(held_out)), "id bigint, t string"), "id", "t")


def test_open_endings_are_told_from_cuts_on_held_out_sentences(ends):
    whole = cut = wrong = 0
    for a in SUBJECTS:
        for b in DEEDS:
            text = f"When it starts, all is well. After that {a} {b}"
            whole += endings(text, ends) == (None, "sentence")
            for n in range(len(text) - len(b) + 2, len(text)):
                got = endings(text[:n], ends)
                cut += got == ("sentence", "sentence")
                wrong += got[0] is None
    assert whole == len(SUBJECTS) * len(DEEDS)
    assert wrong <= 0.05 * (cut + wrong)  # an address or name may look whole when it is cut


def test_shapes():
    assert [shape(x) for x in ("$7E1234,", "#$10", "46.", "FlushGate_Left", "STA", "Table", "(both)")] == ["0$7", "1$4", "0", "_", "A", "table", "both"]
    assert last_part("FlushGate_Left29") == "_left" and last_part("$10") == "" and last_part("hud_core.asm.") == "_asm"


def test_ends_of_an_empty_table(spark):
    ends = fit_ends(spark.createDataFrame([], "id bigint, t string"), "id", "t")
    assert not ends.ends("all is well") and not ends.ends("") and endings(None, ends) == (None, None)


@pytest.fixture(scope="module")
def rare_endings(spark):
    """24,000 texts, of which four say that a sentence can end with "orchard lantern" and two with "harbor lantern"."""
    texts = ["The loop clears the lower byte."] * 24_000
    texts[17::5000] = ["It waits for the orchard lantern."] * 5
    texts[17] = "Then it is done. It waits for the orchard lantern"
    texts[18::12_000] = ["It asks for a harbor."] * 2
    texts[18] = "Then it is done. It asks for a harbor"
    rows = [(k, "m", "What is it?", t) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "result_id bigint, model string, prompt string, response string").repartition(8)


def test_ends_are_learned_from_every_text(rare_endings):
    got = {r["result_id"]: r["inside"] for r in truncated_texts(rare_endings).filter("truncated").collect()}
    assert got == {18: "sentence"}


def test_ends_of_pairs_are_learned_from_every_answer(rare_endings):
    got = [tuple(r) for r in broken_pairs(rare_endings, "result_id", "prompt", "response", source="model").collect()]
    assert got == [(18, "truncated")]


def test_languages_are_learned_from_every_text(spark):
    rows = [(k, SENTENCES["en"][k % 5], "en") for k in range(12_000)]
    text = " ".join(SENTENCES["es"])
    needed = -(-LEAST_WORDS // len(prose_words(text)))  # no text can be spared
    rows[:: 12_000 // needed + 1] = [(k, text, "es") for k in range(0, 12_000, 12_000 // needed + 1)]
    known = fit_languages(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert known.names == ["en", "es"] and known.tell("El contador se guarda en la tabla y luego se borra.") == "es"


def test_bare_headings_at_the_end():
    assert stops_inside("It is done.\n\n### Response") is None and stops_inside("It is not do\n\n### Response") == "sentence"


def test_open_endings_count_at_a_significant_length(spark, ends):
    whole = [f"{a.capitalize()} {b}. Then {c} {d}." for a in SUBJECTS for b in DEEDS for c in SUBJECTS for d in DEEDS]
    limit = 300
    fill = lambda n: ("All is well. " * 40)[: n - 1].rstrip(" .") if n else ""
    rows = [(k, "m", t + " It is so." * (k % 17)) for k, t in enumerate(whole)]
    rows += [(5000 + k, "m", (fill(60 + k) + ". Then the loop clears the lower by")[-limit:].rjust(limit, "x")) for k in range(150)]
    open_end = ". Then the loop clears the lower byte"
    rows += [(9000, "m", "y" * (limit - len(open_end)) + open_end), (9001, "m", "y" * (limit + 7 - len(open_end)) + open_end)]
    rows += [(9002, "m", "y" * (limit - 1) + ".")]
    df = spark.createDataFrame(rows, "result_id bigint, model string, response string")
    got = {r["result_id"]: r for r in truncated_texts(df, ends=ends).collect()}
    assert got[5000]["truncated"] and got[9000]["truncated"] and not got[9001]["truncated"] and not got[9002]["truncated"]
    pairs = df.withColumnRenamed("response", "_a").selectExpr("result_id", "model", "_a as answer", "cast(null as string) as question")
    found = {r["result_id"]: r["defect"] for r in broken_pairs(pairs, "result_id", "question", "answer", ends=ends, source="model").collect()}
    assert found[5000] == found[9000] == "truncated" and 9001 not in found and 9002 not in found


def test_broken_pairs_table(spark):
    rows = [(1, QUESTION, GOOD, "a"), (2, QUESTION, None, "b"), (2, QUESTION, None, "b"), (None, QUESTION, None, "c"), (3, None, "TBD", "d"), (4, QUESTION, "word " * 50_000 + "end.", "e")]
    df = spark.createDataFrame(rows, "id bigint, q string, a string, defect string")
    assert sorted(map(tuple, broken_pairs(df, "id", "q", "a").collect())) == [(2, "empty"), (3, "empty")]
    assert broken_pairs(df.limit(0), "id", "q", "a").count() == 0


def test_length_limits(spark):
    smooth = [int(-120 * math.log(1 - (k + 0.5) / 6000)) + 20 for k in range(6000)]
    rows = [("m", n) for n in smooth] + [("m", 200)] * 300 + [("n", n) for n in smooth] + [(None, 200)] * 400
    df = spark.createDataFrame(rows, "model string, n_chars int")
    found = length_limits(df).collect()
    assert {(r[0], r[1]) for r in found} == {("m", 200)}
    assert length_limits(df.limit(0)).count() == 0


def test_upper_tail():
    assert upper_tail(1, 5.0) == 1.0 and abs(upper_tail(3, 1.0) - 0.0803) < 1e-3 and upper_tail(400, 20.0) < 1e-50


def test_truncated_texts(spark):
    rows = [(1, "m", "It is whole.", "p"), (2, "m", "It is cut in the mid", "p"), (2, "m", "It is cut in the mid", "p"), (3, None, "Also cut off here, and", None), (4, "m", None, "p"), (5, "m", "Say this word again and again now", "Say this word again and again now"), (None, "m", "cut of", "p")]
    df = spark.createDataFrame(rows, "result_id bigint, model string, response string, prompt string")
    got = {r["result_id"]: r["truncated"] for r in truncated_texts(df, prompt_col="prompt").collect()}
    assert got == {1: False, 2: True, 3: True, 4: False, 5: False}
    shares = {r["model"]: r["share"] for r in truncation_by_source(truncated_texts(df, prompt_col="prompt")).collect()}
    assert shares == {"m": 0.25, None: 1.0}


def test_empty_tables_and_clashing_columns(spark):
    df = spark.createDataFrame([], "result_id bigint, model string, response string, prompt string, n_chars int, inside string, at_limit boolean")
    assert truncated_texts(df, prompt_col="prompt").count() == 0 and truncation_by_source(truncated_texts(df)).count() == 0
    assert broken_pairs(df, "result_id", "prompt", "response", source="model").count() == 0
    one = spark.createDataFrame([(1, None, "It is cut in the mid", None, 3, "x", True), (2, "m", "It is whole.", "", 3, "x", True)], df.schema)
    assert [r["truncated"] for r in truncated_texts(one, prompt_col="prompt").orderBy("result_id").collect()] == [True, False]
    assert [tuple(r) for r in broken_pairs(one, "result_id", "prompt", "response", source="model").collect()] == [(1, "truncated")]
