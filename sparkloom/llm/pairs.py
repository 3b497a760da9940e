"""Broken question-answer and instruction-response pairs (problem 4)."""

from __future__ import annotations

import re
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut_lineage, spread
from .endings import Asking, EndModel, end_runs, with_verdict
from .languages import Languages
from .lengths import length_limits
from .refusals import is_refusal
from .structure import endings
from .tiling import tiles
from .words import HASHES, each_word, words

# What stands in for a missing answer, as words.
_STAND_INS = set(
    "n a|na|none|null|nil|nan|nul|tbd|tba|todo|empty|blank|void|undefined|missing|unknown|no output|no answer|no response|no content|no data|no text|not available|not applicable|"
    "output|answer|response|placeholder|leer|keine antwort|vide|aucune réponse|vacío|sin respuesta|vazio|sem resposta|k a|n d|s o|なし|無し|未定".split("|")
)
_LONGEST_STAND_IN = max(len(x.split()) for x in _STAND_INS)
_FENCE_MARK = re.compile("```[a-z]*")
#: Questions whose language a task remembers, as many answers share one.
_QUESTIONS_KEPT = 20_000
_LEAD = re.compile(r"\W*(?:\w+ ){0,4}\w+:\s+")
_WRAPPER_LINE = re.compile(r"^\s*(?:#{1,6}\s*)?\W*(?:question|instruction|prompt|input|task|user|human|q|request|query|response|answer|assistant|output)\W*$", re.I)

def is_empty(answer: str | None) -> bool:
    """No answer: nothing visible, mere marks, or a stand-in for a missing value."""
    ws = list(islice(each_word(answer), _LONGEST_STAND_IN + 1))
    return not ws or " ".join(ws) in _STAND_INS or not re.search(r"[^\W_]", _FENCE_MARK.sub("", answer)) if len(ws) <= _LONGEST_STAND_IN else False


def is_echo(answer: str, question: str) -> bool:
    """Whether an answer holds nothing but the question, once or several times, by greedy string tiling.

    A lead of up to five words before a colon and lines that only name a part (such as a response
    heading) are left out first. What one tiling does not cover is tiled again. A short excerpt of the
    question can be a sound answer; words of the answer's own at its end make it one.
    """
    lines = answer.split("\n")
    end = next((w for x in reversed(lines) if not _WRAPPER_LINE.match(x) for w in words(x)[-1:]), None)
    if end is None or end not in question.lower():
        return False  # words of its own at the end
    kept = "\n".join(x for x in lines if not _WRAPPER_LINE.match(x))
    q = words(question)
    options = [kept]
    if lead := _LEAD.match(kept):
        options.append(kept[lead.end() :])
    for option in options:
        a = words(option)
        known = set(q)
        if not a or len(a) < 0.5 * len(q) and len(a) < 12 or sum(w in known for w in a) < 0.95 * len(a):
            continue  # no tiling can cover more
        rest, least = a, min(3, len(a))
        while rest:
            found = tiles(rest, q, HASHES.array(rest), HASHES.array(q), least)
            used = {k for i, _, n in found for k in range(i, i + n)}
            if not used or len(used) < min(len(rest), 0.5 * len(q)) * 0.5:
                break
            rest = [w for k, w in enumerate(rest) if k not in used]
        if len(rest) <= 0.05 * len(a) and a[-1:] != rest[-1:]:
            return True
    return False


def _other(answer: str, languages: Languages | None, asked: tuple[str, ...]) -> str | None:
    return "other_language" if asked and languages and languages.differs(asked, answer) else None


def defects(question: str | None, answer: str | None, ends: EndModel | None = None, languages: Languages | None = None, asked: tuple[str, ...] = ()) -> tuple[str | None, str | None]:
    """What :func:`defect` says of an answer at any length, and of one at a significant length of its source."""
    if is_empty(answer):
        return ("empty",) * 2
    if question and is_echo(answer, question):
        return ("echo",) * 2
    if is_refusal(answer):
        return ("refusal",) * 2
    sure, at_limit = endings(answer, ends)
    other = None if sure else _other(answer, languages, asked)
    return "truncated" if sure else other, "truncated" if at_limit else other


def defect(question: str | None, answer: str | None, ends: EndModel | None = None, languages: Languages | None = None) -> str | None:
    """empty, echo, refusal, truncated or other_language, the first that holds; None for a sound answer.

    Without ``ends`` every ending without a mark is a cut, without ``languages`` no language is told.
    """
    return defects(question, answer, ends, languages, languages.plausible(question) if languages else ())[0]


def broken_pairs(
    df: DataFrame,
    id_col: str,
    question_col: str,
    answer_col: str,
    languages: Languages | None = None,
    ends: EndModel | None = None,
    source: str | None = None,
) -> DataFrame:
    """(``id_col``, defect) of each distinct id whose answer is defective.

    Without ``ends`` the sentences of all answers say where one can end. With a ``source`` an answer that is
    complete but for its closing mark is ``truncated`` if its length is significant for its source, as in
    :func:`.truncation.truncated_texts`. Without a question (null or empty) only the answer counts: neither
    ``echo`` nor ``other_language`` is given then. A null answer is ``empty``. Rows with a null id are left
    out; of rows that share an id the first defect in alphabetical order stands. Texts are read whole;
    only ids, lengths and defects are shuffled. Other columns are ignored.
    """
    shared = df.sparkSession.sparkContext.broadcast((ends, languages))
    kind = lambda c: df.select(c).schema[0].dataType.simpleString()
    schema = f"_id {kind(id_col)}, _source {kind(source) if source else 'string'}, _n int, _plain string, _limit string, _asked array<bigint>, _whole string"

    def run(batches):
        ends, languages = shared.value
        ends = ends or Asking()
        asked: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            found, rows, keys, whole = [], [], [], []
            answers = batch.column(3).to_pylist()
            for k, (question, answer) in enumerate(zip(batch.column(2).to_pylist(), answers)):
                if languages and question and question not in asked:
                    if len(asked) >= _QUESTIONS_KEPT:
                        asked.clear()
                    asked[question] = languages.plausible(question)
                one = defects(question, answer, ends, languages, asked.get(question, ()))
                open_end = ends.take() if isinstance(ends, Asking) else None
                if one[0] or one[1]:
                    found.append(one)
                    rows.append(k)
                    keys.append(open_end)
                    whole.append(_other(answer, languages, asked.get(question, ())) if open_end is not None else None)
            at = pa.array(rows, pa.int64())
            lengths = pa.array([len(answers[k] or "") for k in rows], pa.int32())
            plain, limit = (pa.array([x[s] for x in found], pa.string()) for s in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), lengths, plain, limit, pa.array(keys, pa.list_(pa.int64())), pa.array(whole, pa.string())], ["_id", "_source", "_n", "_plain", "_limit", "_asked", "_whole"])

    flat = df.select(F.col(id_col).alias("_id"), (F.col(source) if source else F.lit(None).cast("string")).alias("_source"), F.col(question_col).alias("_q"), F.col(answer_col).alias("_a"))
    found = spread(flat).mapInArrow(run, schema).filter(F.col("_id").isNotNull())
    if ends is None:
        found = with_verdict(cut_lineage(found), "_asked", end_runs(flat.filter(F.col("_id").isNotNull()), "_a"), "_ended")
        found = found.withColumn("_plain", F.when(F.col("_ended"), F.col("_whole")).otherwise(F.col("_plain")))
    if source:
        lengths = flat.filter(F.col("_id").isNotNull()).groupBy("_id").agg(F.min(F.struct("_source", F.length("_a").alias("_n"))).alias("r")).select("r.*")
        limits = length_limits(lengths, "_source", "_n").select("_source", "_n", F.lit(True).alias("_hit"))
        found = found.join(limits, ["_source", "_n"], "left").withColumn("_plain", F.when(F.col("_hit"), F.col("_limit")).otherwise(F.col("_plain")))
    return found.filter(F.col("_plain").isNotNull()).groupBy(F.col("_id").alias(id_col)).agg(F.min("_plain").alias("defect"))
