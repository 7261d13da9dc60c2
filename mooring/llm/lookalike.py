"""Visually identical text: look-alike classes and one form for each.

Strings and code points that look the same are joined by union-find, transitively.  A
class that holds a string of several code points (a ligature's letters, the empty string
of a character that shows nothing) is represented by that string, spelt in its parts'
representatives, so that every way of writing it ends in one form; any other class by
the member that is most frequent in the whole table.  Text is decomposed canonically,
rewritten greedily (leftmost, longest pattern) by an automaton over all patterns, and
composed again, so accents count however they are stored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mooring.shared import materialise

# Code points of other scripts (Greek, Cyrillic, Armenian, Cherokee, number
# forms) that look like the letter before the colon.
LETTERS = (
    "A:АΑᎪ B:ВΒᏴ C:СⅭϹᏟ D:ⅮᎠ E:ЕΕᎬ G:ԌᏀ H:НΗᎻ I:ІΙⅠӀ J:ЈͿᎫ K:КΚᏦ L:ⅬᏞ M:МΜⅯᎷ N:Ν O:ОΟՕ P:РΡᏢ Q:Ԛ R:Ꭱ S:ЅᏚ T:ТΤᎢ U:Ս V:ⅤѴᏙ W:ԜᎳ X:ХΧⅩ Y:ΥҮ Z:ΖᏃ "
    "a:а c:сⅽϲ d:ԁⅾ e:е g:ɡց h:һհ i:іⅰ j:јϳյ l:ⅼӏ m:ⅿ n:ո o:оοօ p:р q:ԛ s:ѕ u:ս v:νⅴѵ w:ԝ x:хⅹ y:у"
)
# Hyphens, and characters beside those of category Cf that show nothing.
HYPHENS = "‐‑﹣－"
INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍ㅤﾠ"
#: Code points of category Cf that do show something (fixed values).
VISIBLE = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
#: Code points whose compatibility form reads the same letter by letter (fixed ranges).
SPELT = ((0x2160, 0x2180), (0xFB00, 0xFB07), (0x2026, 0x2027))


@lru_cache(1)
def look_alikes() -> tuple[tuple[str, str], ...]:
    """Pairs of strings that look the same: the fixed letters, and by rule from Unicode's own
    data the wide and narrow forms, spaces, invisible characters and spelt-out ones."""
    pairs = [(letter, other) for entry in LETTERS.split() for letter, others in [entry.split(":")] for other in others]
    pairs += [("-", h) for h in HYPHENS] + [("", c) for c in INVISIBLE]
    spelt = {c for low, high in SPELT for c in range(low, high)}
    for code in range(0x80, 0x110000):
        char = chr(code)
        kind, _, form = unicodedata.decomposition(char).partition("> ")
        category = unicodedata.category(char)
        if category == "Zs" and code != 0x1680:
            pairs.append((" ", char))
        elif (category == "Cf" and code not in VISIBLE) or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF:
            pairs.append(("", char))
        elif form and (kind in ("<wide", "<narrow") or code in spelt):
            pairs.append(("".join(chr(int(x, 16)) for x in form.split()), char))
    return tuple(pairs)


class Classes:
    """Union-find over strings."""

    def __init__(self, pairs: Iterable[tuple[str, str]]):
        self.up: dict[str, str] = {}
        for a, b in pairs:
            # what canonical decomposition splits is seen in its parts only
            a, b = unicodedata.normalize("NFD", a), unicodedata.normalize("NFD", b)
            x, y = self.root(a), self.root(b)
            if x != y:
                self.up[max(x, y)] = min(x, y)

    def root(self, s: str) -> str:
        self.up.setdefault(s, s)
        while self.up[s] != s:
            self.up[s] = self.up[self.up[s]]
            s = self.up[s]
        return s

    def members(self) -> dict[str, list[str]]:
        found: dict[str, list[str]] = {}
        for s in sorted(self.up):
            found.setdefault(self.root(s), []).append(s)
        return found

    def rewriting(self, frequency: dict[str, int]) -> dict[str, str]:
        """pattern -> representative, for every member that isn't one."""
        order = lambda s: (-frequency.get(s, 0), len(s), s)
        groups = {r: sorted(m, key=order) for r, m in self.members().items()}
        of = {s: r for r, m in groups.items() for s in m}

        def spell(s: str, above: tuple[str, ...]) -> str:
            root = of.get(s)
            if root is None or root in above:
                return s
            split = [m for m in groups[root] if len(m) != 1]
            if not split:
                return groups[root][0]
            return "".join(spell(c, (*above, root)) for c in split[0])

        return {s: form for s in of if s and (form := spell(s, ())) != s}


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each code point occurs in a task's texts."""
    total: dict[int, int] = {}
    for batch in batches:
        text = unicodedata.normalize("NFD", "".join(t for t in batch.column(0).to_pylist() if t))
        codes, counts = np.unique(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32), return_counts=True)
        for c, n in zip(codes.tolist(), counts.tolist()):
            total[c] = total.get(c, 0) + n
    yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int32()), pa.array(total.values(), pa.int64())], names=["code", "n"])


def rewriting_of(df: DataFrame, text: str) -> dict[str, str]:
    """The patterns and representatives for a table, by its whole texts' frequencies.  Only
    counts of the table's class members reach the driver, however large the table is."""
    classes = Classes(look_alikes())
    singles = [ord(s) for s in classes.up if len(s) == 1]
    counts = (df.select(F.col(text).cast("string")).mapInArrow(_counted, "code int, n long")
              .where(F.col("code").isin(singles)).groupBy("code").agg(F.sum("n").alias("n")))
    return classes.rewriting({chr(c): n for c, n in counts.collect()})


def rewriter(patterns: dict[str, str]):
    """A function from a text to its one form."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for pattern, form in patterns.items():
        machine.add_word(pattern, (len(pattern), form))
    machine.make_automaton()
    # no match reaches beyond a run of characters that can occur in patterns; runs, words
    # mostly, come again and again, so each is rewritten once
    material = {c for p in patterns for c in p if c.isascii()}
    runs = re.compile("[^" + re.escape("".join(c for c in map(chr, range(128)) if c not in material)) + "]+")

    @lru_cache(1 << 16)
    def rewritten(run: str) -> str:
        out, at = [], 0
        for end, (size, form) in machine.iter_long(run):
            out += (run[at:end - size + 1], form)
            at = end + 1
        return "".join([*out, run[at:]])

    def rewrite(text: str) -> str:
        if text.isascii() and not material:
            return text
        return unicodedata.normalize("NFC", runs.sub(lambda m: rewritten(m[0]), unicodedata.normalize("NFD", text)))

    return rewrite


def one_form(df: DataFrame, text: str, form: str = "one_form") -> DataFrame:
    """``df`` with the column ``form``: the text in its one form, null where it is null.

    Two texts that read the same, letter by letter, get equal forms.  Case, accents, digits,
    raised figures and line breaks stay; an empty text and one of invisible characters
    become the empty text.  Repeated rows are all kept; an empty table gives no rows.  A
    column that already has the name ``form`` is an error.
    """
    if form in df.columns:
        raise ValueError(f"the table already has a column {form!r}")
    patterns = rewriting_of(df, text)
    schema = T.StructType([*df.schema.fields, T.StructField(form, T.StringType())])
    where = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewrite = rewriter(patterns)
        for batch in batches:
            forms = [None if t is None else rewrite(t) for t in batch.column(where).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forms, pa.string())], names=[*batch.schema.names, form])

    return df.mapInArrow(run, schema)


def _looks(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, look, stored), a written table: its readers share one rewriting."""
    rows = df.select(F.col(key).alias("id"), F.col(text).cast("string").alias("txt")).where("id is not null and txt <> ''")
    # 128-bit digests stand for texts from here on
    forms = one_form(rows, "txt").select("id", F.unhex(F.md5("one_form")).alias("look"), F.unhex(F.md5("txt")).alias("stored"))
    return materialise(forms, "looks").distinct()


def look_alike_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs (id_a < id_b) whose texts have one form but aren't stored alike.  Null ids, null
    and empty texts take no part; classes of only equal texts are dropped before any pair
    is made; repeated rows count once."""
    looks = _looks(df, key, text)
    mixed = looks.groupBy("look").agg(F.min("stored").alias("a"), F.max("stored").alias("b")).where("a <> b").select("look")
    several = looks.join(mixed, "look", "left_semi")
    left = several.select("look", F.col("id").alias("id_a"), F.col("stored").alias("sa"))
    right = several.select("look", F.col("id").alias("id_b"), F.col("stored").alias("sb"))
    return left.join(right, "look").where("id_a < id_b and sa <> sb").select("id_a", "id_b").distinct()


def look_alike_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(class_id, id, forms, members): one row per id with a text; class_id is the smallest id
    whose text reads the same, forms counts the ways it is stored, members the ids."""
    looks = _looks(df, key, text)
    forms = looks.groupBy("look", "stored").agg(F.min("id").alias("low"), F.count("*").alias("n"))
    sums = forms.groupBy("look").agg(F.min("low").alias("class_id"), F.count("*").alias("forms"), F.sum("n").alias("members"))
    return looks.join(sums, "look").select("class_id", "id", "forms", "members")
