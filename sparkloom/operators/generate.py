"""Samples from templates and literal tables, with seeded choices."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import seeded_uniform


def choice(options: list[str], seed: int, *key: Column) -> Column:
    """One of some texts, by a hash of seed and key."""
    at = F.floor(seeded_uniform(seed, *key) * len(options)).cast("int")
    return F.get(F.array(*map(F.lit, options)), at)


def fill(template: Column, slots: dict[str, Column]) -> Column:
    """A template with each ``{slot}`` replaced."""
    for name, value in slots.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def expand(df: DataFrame, key: str, n: int, instruction: str, output: str, slots: dict[str, list[str]], thinking: str | None = None, seed: int = 42) -> DataFrame:
    """(key, draw, instruction, output[, thinking]): ``n`` samples for each row of templates.

    Slots of the instruction and of the output are drawn on their own, each by a hash of key, draw, slot and
    place; ``thinking`` takes the output's draws, as it leads there. Columns of the row may fill slots too.
    """
    rows = df.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    drawn = lambda place: {s: choice(options, seed, F.col(key), F.col("draw"), F.lit(s), F.lit(place)) for s, options in slots.items()}
    ask, answer = drawn("instruction"), drawn("output")
    more = [fill(F.col(thinking), answer).alias("thinking")] if thinking else []
    return rows.select(key, "draw", fill(F.col(instruction), ask).alias("instruction"), fill(F.col(output), answer).alias("output"), *more)


def register_samples(registers: DataFrame) -> DataFrame:
    """(address, kind, instruction, output): a reference, a reverse lookup and a warning for each row (address, name, purpose, note)."""
    sample = lambda kind, ask, answer: F.struct(F.lit(kind).alias("kind"), ask.alias("instruction"), answer.alias("output"))
    named = F.concat("name", F.lit(" ("), "address", F.lit(")"))
    made = F.array(
        sample("reference", F.concat(F.lit("What does register "), named, F.lit(" do?")), F.concat(named, F.lit(" "), "purpose", F.lit("."))),
        sample("lookup", F.concat(F.lit("Which register "), "purpose", F.lit("?")), named),
        F.when(F.coalesce("note", F.lit("")) != "", sample("warning", F.concat(F.lit("What must be kept in mind with "), "name", F.lit("?")), F.col("note"))),
    )
    return registers.select("address", F.explode(F.array_compact(made)).alias("_s")).select("address", "_s.*")


def conflict_samples(symbols: DataFrame, n: int = 20) -> DataFrame:
    """(address, kind, instruction, input, output): for each of the first ``n`` symbols (address, name) a code change that contradicts it and one that does not."""
    ask = "Identify if the following code change conflicts with the project's RAM documentation."
    known = F.concat(F.lit("Documentation: "), "name", F.lit(" is at "), "address", F.lit("\nCode Change: "))
    against = F.struct(F.lit("conflict").alias("kind"), F.concat(known, F.lit("STA "), "address", F.lit(" ; Store Link's Health")).alias("input"), F.concat(F.lit("CONFLICT: The code uses "), "address", F.lit(" for Link's Health, but documentation identifies this address as "), "name", F.lit(".")).alias("output"))
    within = F.struct(F.lit("no_conflict").alias("kind"), F.concat(known, F.lit("LDA !"), "name", F.lit(" ; Load the "), "name", F.lit(" state")).alias("input"), F.lit("NO CONFLICT: The code correctly uses the documented label and address.").alias("output"))
    first = symbols.orderBy("address").limit(n)
    return first.select("address", F.explode(F.array(against, within)).alias("_s")).select("address", F.col("_s.kind").alias("kind"), F.lit(ask).alias("instruction"), "_s.input", "_s.output")


@dataclass
class Generators:
    """Generators by name: functions from a frame to samples, with a test of the rows that each takes."""

    entries: dict[str, tuple[Callable[[DataFrame], DataFrame], Callable[[], Column]]] = field(default_factory=dict)

    def add(self, name: str, make: Callable[[DataFrame], DataFrame], takes: Callable[[], Column] = lambda: F.lit(True)) -> None:
        self.entries[name] = (make, takes)

    def run(self, df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
        """(samples, report): samples have ``columns`` and their generator's name; the report counts rows taken and skipped by generator."""
        made = reports = None
        for name, (make, takes) in self.entries.items():
            test = F.coalesce(takes(), F.lit(False))
            one = make(df.filter(test)).select(*columns).withColumn("generator", F.lit(name))
            counts = df.agg(F.count_if(test).alias("taken"), F.count_if(~test).alias("skipped")).withColumn("generator", F.lit(name))
            made = one if made is None else made.unionByName(one)
            reports = counts if reports is None else reports.unionByName(counts)
        if made is None:
            raise ValueError("no generator was added")
        return made, reports
