"""Texts cut off by field limits or in transfer (problem 5)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut_lineage, spread
from .endings import Asking, EndModel, end_runs, with_verdict
from .lengths import length_limits
from .pairs import is_echo
from .structure import endings


def stops(df: DataFrame, id_col: str, text_col: str, source: str, prompt_col: str | None = None, ends: EndModel | None = None) -> DataFrame:
    """(id, source, n_chars, inside, inside_at_limit, asked) of each row; they name what the text stops inside.

    ``inside`` is set for endings that are cut at any length, ``inside_at_limit`` also for those that are so
    only where the length speaks for a cut. A text that repeats its prompt, which may itself end in bare
    code, is not cut. Without ``ends``, ``asked`` has the keys of :func:`.endings.with_verdict` where the end of a
    sentence is open: ``inside`` is null if the verdict is that it ends there. Else ``asked`` is null.
    """
    shared = df.sparkSession.sparkContext.broadcast(ends)
    cols = [id_col, source, text_col, *([prompt_col] if prompt_col else [])]
    schema = ", ".join(f"{c} {df.select(c).schema[0].dataType.simpleString()}" for c in (id_col, source)) + ", n_chars int, inside string, inside_at_limit string, asked array<bigint>"

    def run(batches):
        known = shared.value or Asking()
        for batch in batches:
            texts = batch.column(2).to_pylist()
            prompts = batch.column(3).to_pylist() if prompt_col else [None] * len(texts)
            n, sure, limit, asked = [], [], [], []
            for text, prompt in zip(texts, prompts):
                a, b = endings(text, known)
                keys = known.take() if isinstance(known, Asking) else None
                if (a or b) and prompt and is_echo(text, prompt):
                    a = b = keys = None
                n.append(None if text is None else len(text))
                sure.append(a)
                limit.append(b)
                asked.append(keys)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int32()), pa.array(sure, pa.string()), pa.array(limit, pa.string()), pa.array(asked, pa.list_(pa.int64()))],
                [id_col, source, "n_chars", "inside", "inside_at_limit", "asked"],
            )

    return spread(df.select(*cols)).mapInArrow(run, schema)


def truncated_texts(
    df: DataFrame, id_col: str = "result_id", text_col: str = "response", source: str = "model", prompt_col: str | None = None, ends: EndModel | None = None
) -> DataFrame:
    """(id, source, n_chars, inside, at_limit, truncated), one row for each distinct id.

    Endings are of three kinds. Surely cut are those inside a word, after a word that ends no sentence, in an
    open code block, bracket, quotation or list item: they count at any length. Open are whole
    sentences without their mark, a full stop after half a file name, a jump's operand: they count at
    a length where the source's hazard is significant. Any other text is complete, whatever its length.
    Null and empty texts are not truncated; rows of a null id are left out; a repeated id counts once;
    texts of a null source are judged by their ending alone. The texts are scanned once,
    and once more for the ends of their sentences unless ``ends`` is given: only ids, lengths, verdicts and
    counts of runs of words are shuffled.
    """
    seen = cut_lineage(stops(df, id_col, text_col, source, prompt_col, ends).filter(F.col(id_col).isNotNull()).dropDuplicates([id_col]))
    if ends is None:
        seen = with_verdict(seen, "asked", end_runs(df.filter(F.col(id_col).isNotNull()), text_col), "_ended")
        seen = seen.withColumn("inside", F.when(~F.col("_ended"), F.col("inside"))).drop("_ended")
    limits = length_limits(seen, source).select(F.col(source).alias("_s"), F.col("n_chars").alias("_n"), F.lit(True).alias("at_limit"))
    joined = seen.join(limits, (F.col(source) == F.col("_s")) & (F.col("n_chars") == F.col("_n")), "left")
    at_limit = F.coalesce("at_limit", F.lit(False))
    inside = F.when(at_limit, F.col("inside_at_limit")).otherwise(F.col("inside"))
    return joined.select(id_col, source, "n_chars", inside.alias("inside"), at_limit.alias("at_limit"), inside.isNotNull().alias("truncated"))


def truncation_by_source(verdicts: DataFrame, source: str = "model") -> DataFrame:
    """(source, texts, truncated, at_limit, share) of :func:`truncated_texts`; a null source is a group."""
    return verdicts.groupBy(source).agg(
        F.count(F.lit(1)).alias("texts"),
        F.count_if("truncated").alias("truncated"),
        F.count_if(F.col("truncated") & F.col("at_limit")).alias("at_limit"),
        (F.count_if("truncated") / F.count(F.lit(1))).alias("share"),
    )
