"""Languages of prose: scripts by their letters, languages of the Latin script by profiles of character runs."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import spread
from .structure import is_code
from .words import HASHES

#: Counters of a profile; runs of characters share them by hash. A language takes 64 kB of the broadcast.
COUNTERS = 1 << 14
#: Languages kept, the most frequent first, and the words that a language needs in the table.
MOST_LANGUAGES, LEAST_WORDS = 32, 300
#: The most that one word counts, as a logarithm of a likelihood ratio.
WORD_WEIGHT = 4.0
#: What is added to the share of each counter, for runs that a profile has not seen.
UNSEEN = 2e-5
#: Evidence against the question's language that makes an answer's language another one: in all, and for each word.
SURE, SURE_WORD = 6.0, 1.0
#: Words remembered, and those of a text added up at a time.
_CACHED = 100_000
#: Different words that a task adds up before it counts their runs.
_HELD = 200_000

# Letters of the scripts, as ranges, and the names they are given.
_SCRIPTS = [(re.compile(p), k) for p, k in (("[぀-ヿㇰ-ㇿｦ-ﾟ]", "ja"), ("[가-힯ᄀ-ᇿ]", "ko"), ("[Ѐ-ӿ]", "cyrl"), ("[؀-ۿ]", "arab"), ("[֐-׿]", "hebr"), ("[ऀ-ॿ]", "deva"), ("[Ͱ-Ͽ]", "grek"), ("[฀-๿]", "thai"), ("[一-鿿]", "zh"))]
_OTHER_SCRIPT = re.compile("[Ͱ-ࣿऀ-ᇿ぀-鿿가-힯ｦ-ﾟ]")
_FENCED = re.compile(r"```.*?(?:```|$)", re.S)
_QUOTED = re.compile(r"[“„][^”“\n]*[”“]|«[^»\n]*»|\"[^\"\n]*\"|`[^`\n]*`|「[^」\n]*」|『[^』\n]*』")
# A word between blanks, with or without marks around it.
_WORD = re.compile(r"(?<!\S)[.,;:!?¡¿()\[\]{}…*\-–—_>'’\"]*([^\W\d_]+)[.,;:!?¡¿()\[\]{}…*\-–—_>'’\"]*(?!\S)")
_LABEL = re.compile(r"^\s*([a-z]{2})(?:[-_][a-z0-9-]+)?\s*$")


def prose(text: str) -> str:
    """The text without code blocks and quotations."""
    if "`" in text:
        text = _FENCED.sub("\n", text)
    return _QUOTED.sub(" ", text) if "“" in text or "„" in text or '"' in text or "«" in text or "`" in text or "「" in text or "『" in text else text


def prose_words(text: str) -> list[str]:
    """The words that can tell a language, lower-cased: names, registers and lines of a listing are none."""
    if "\n" in text:
        text = "\n".join(line for line in text.split("\n") if not is_code(line))
    found = _WORD.findall(text)
    if text.isupper():  # a text in capitals; instructions have three letters
        return [w.lower() for w in found if len(w) > 3]
    return [w.lower() for w in found if w.islower() or w.istitle() and len(w) > 1]


def script(text: str) -> str | None:
    """The script of a text of which a quarter of the letters are not Latin."""
    if text.isascii() or not _OTHER_SCRIPT.search(text):
        return None
    letters = sum(map(str.isalpha, text))
    for pattern, name in _SCRIPTS:
        n = len(pattern.findall(text))
        if n >= 4 and n >= 0.25 * letters:
            return name
    return None


def _runs(word: str) -> np.ndarray:
    """Counters of a word's runs of two to four characters, its edges included, and of the word itself."""
    w = f"<{word}>"
    runs = [w[k : k + n] for n in (2, 3, 4) for k in range(len(w) - n + 1)]
    return (HASHES.array([*runs, w]) % np.uint64(COUNTERS)).astype(np.int64)


class Languages:
    """Profiles of languages; an empty one knows scripts only."""

    def __init__(self, names: list[str], counts: np.ndarray) -> None:
        self.names = names
        # Shares, not counts, are smoothed: a run that no profile knows speaks for none, however large they are.
        shares = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
        self.logs = np.log(shares + UNSEEN).astype(np.float32)
        self._rows: dict[str, int] = {}
        self._words = np.empty((0, len(names)), np.float32)

    def _row(self, w: str) -> int:
        """Where the evidence of a word stands: by language, 0 for the best one and never below -``WORD_WEIGHT``."""
        at = self._rows[w] = len(self._rows)
        if at >= len(self._words):
            self._words = np.concatenate([self._words, np.empty((max(1024, at), len(self.names)), np.float32)])
        score = self.logs[:, _runs(w)].mean(axis=1) * 2.0
        self._words[at] = np.maximum(score - score.max(), -WORD_WEIGHT)
        return at

    def total(self, words: list[str]) -> np.ndarray:
        """Evidence of several words by language."""
        total = np.zeros(len(self.names), np.float32)
        for k in range(0, len(words), _CACHED):
            if len(self._rows) >= _CACHED:
                self._rows.clear()
            rows = [self._rows[w] if w in self._rows else self._row(w) for w in words[k : k + _CACHED]]
            total += self._words[rows].sum(axis=0)
        return total

    def plausible(self, text: str | None, margin: float = 3.0) -> tuple[str, ...]:
        """The languages that a text's prose may be in, the likeliest first, or its script; empty without any word.

        A short text may be in several: all whose evidence is within ``margin`` of the best one's.
        """
        text = prose(text) if text else ""
        if found := script(text):
            return (found,)
        words = prose_words(text)
        if not words or not self.names:
            return ()
        total = self.total(words)
        return tuple(self.names[k] for k in np.argsort(-total, kind="stable").tolist() if total[k] >= total.max() - margin)

    def tell(self, text: str | None, margin: float = 3.0) -> str | None:
        """The language or script of a text's prose, None if there is too little evidence."""
        found = self.plausible(text, margin)
        return found[0] if len(found) == 1 else None

    def differs(self, asked: tuple[str, ...], answer: str) -> bool:
        """Whether an answer's prose is surely in another language than any of ``asked``, the question's plausible ones.

        Every word may speak for either, so the evidence has to reach a sum and an average for each word;
        a few foreign words in an answer do not.
        """
        text = prose(answer)
        if found := script(text):
            return bool(asked) and found not in asked
        among = [k for k, name in enumerate(self.names) if name in asked]
        words = prose_words(text)
        if not words or not among:
            return False
        total = self.total(words)
        apart = float(total.max() - total[among].max())
        return apart >= SURE and apart >= SURE_WORD * len(words)


def fit_languages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Languages:
    """Fits profiles on all labelled texts that have an id.

    A label counts if it begins with a code of two letters; others, and null, are left out, as are listings,
    code blocks and quotations. Wrong labels only blur the profiles; a label of texts mostly in another
    script gets none. The driver gets at most
    ``MOST_LANGUAGES`` x ``COUNTERS`` counts. An empty table gives a model that knows scripts only.
    """

    def count(batches):
        sums: dict[str, tuple[np.ndarray, Counter]] = {}

        def counted():
            for table, words in sums.values():
                for w, n in words.items():
                    np.add.at(table, _runs(w), n)
                table[COUNTERS] += words.total()
                words.clear()

        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                known = _LABEL.match(label.lower()) if label and text else None
                if not known:
                    continue
                text = prose(text)
                table, words = sums.setdefault(known.group(1), (np.zeros(COUNTERS + 3, np.int64), Counter()))
                other = script(text) is not None
                table[COUNTERS + 1 + other] += 1
                if not other:
                    words.update(prose_words(text))
            if sum(len(words) for _, words in sums.values()) > _HELD:
                counted()
        counted()
        for name, (table, _) in sums.items():
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(table[at])], ["name", "slot", "n"])

    labelled = spread(df.filter(F.col(id_col).isNotNull()).select(label_col, text_col))
    summed = labelled.mapInArrow(count, "name string, slot int, n bigint").groupBy("name", "slot").agg(F.sum("n").alias("n"))
    summed = summed.groupBy("name").agg(F.collect_list(F.struct("slot", "n")).alias("slots"))
    tables = {}
    for row in summed.toArrow().to_pylist():  # at most 26 x 26 codes of two letters
        table = np.zeros(COUNTERS + 3, np.int64)
        for part in row["slots"]:
            table[part["slot"]] += part["n"]
        tables[row["name"]] = table
    latin = lambda t: t[COUNTERS] >= LEAST_WORDS and t[COUNTERS + 1] > t[COUNTERS + 2]
    names = sorted((n for n in tables if latin(tables[n])), key=lambda n: (-tables[n][COUNTERS], n))[:MOST_LANGUAGES]
    return Languages(names, np.stack([tables[n][:COUNTERS] for n in names]) if names else np.zeros((0, COUNTERS)))
