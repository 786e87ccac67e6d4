"""Licence notices and full licence texts in documents, by DataFrame functions alone.

Method: the words of a whole text, across its lines, are compared to licence templates
by the Dice coefficient of sets of word bigrams, window by window. Twice the overlap of
sets of a and b bigrams over a + b can reach the threshold t only if a is from
b * t / (2 - t) to b * (2 - t) / t. These size bounds prune templates (a text that has
fewer of a template's bigrams than the least size is not searched for it) and windows.

A window starts where a run of a template's bigrams starts, or at the template's first
bigram, and ends where a run ends, or at the last: others outside such a run only lower
the coefficient, and those inside never do. All of it is one projection over the scan,
without a shuffle.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter

from pyspark.sql import Column, DataFrame, functions as F

from .common import table
from .licence_texts import TEXTS

THRESHOLD = 0.8
#: Licence notices by SPDX identifier.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-2-Clause", "Released under the 2-Clause BSD License."),
    ("BSD-3-Clause", "Released under the 3-Clause BSD License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("All-Rights-Reserved", "All rights reserved."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
#: The notices and the full texts.
TEMPLATES = [*NOTICES, *TEXTS.items()]


def words_in(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def bigrams_in(text: str) -> list[str]:
    words = words_in(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def size_bounds(size: int, threshold: float) -> tuple[int, int]:
    """Least and largest number of bigrams that can reach the threshold with ``size``."""
    fits = [n for n in range(1, 3 + int(2 * size / threshold)) if 2 * min(n, size) / (n + size) >= threshold]
    return fits[0], fits[-1]


def shapes_of(templates: list[tuple[str, str]], threshold: float) -> list[dict]:
    """Each template's bigrams, the first and the last of them, and its size bounds: the
    least and the largest number of distinct bigrams of a window."""
    shapes = []
    for k, (name, text) in enumerate(templates):
        words, grams = words_in(text), bigrams_in(text)
        lo, hi = size_bounds(len(grams), threshold)
        ends = f"{words[0]} {words[1]}", f"{words[-2]} {words[-1]}"
        shapes.append({"k": k, "licence": name, "lo": lo, "hi": hi, "grams": grams, "first": ends[0], "last": ends[1]})
    return shapes


def signatures(shapes: list[dict]) -> list[str]:
    """Bigrams of which every window that can reach the threshold has one at least.

    It shares at least ``lo`` of a template's bigrams, so of any larger choice than the
    remainder it has one. Bigrams of several templates are chosen first, then long ones,
    which are rare elsewhere.
    """
    held = Counter(g for s in shapes for g in s["grams"])
    chosen = set()
    for s in shapes:
        spare = len(s["grams"]) - s["lo"] + 1
        chosen.update(sorted(s["grams"], key=lambda g: (len(s["grams"]) > 40 or -held[g], -len(g), g))[:spare])
    return sorted(chosen)


def hashed(grams: list[str]) -> list[list[str]]:
    """A hash table as a list of short lists, by crc32."""
    table_ = [[] for _ in grams]
    for g in grams:
        table_[zlib.crc32(g.encode()) % len(table_)].append(g)
    return table_


def fixed(value, kind: str) -> Column:
    """A literal of any size, folded once when the plan is made."""
    return F.from_json(F.lit(json.dumps({"v": value})), f"v {kind}")["v"]


def among(gram: Column, table_: Column) -> Column:
    return F.array_contains(F.get(table_, (F.crc32(gram) % F.size(table_)).cast("int")), gram)


def bigrams(words: Column) -> Column:
    """Of each two adjacent words, repeats included."""
    pairs = F.transform(words, lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1)))
    return F.slice(pairs, 1, F.greatest(F.size(words) - 1, F.lit(0)))


def chained(value: Column, *steps) -> Column:
    """Apply the steps to an array of one, each of which binds what it is given, so that
    nothing is worked out twice; gives the array of what is left."""
    out = F.array(value)
    for step in steps:
        out = step(out)
    return out


def each(f):
    return lambda found: F.transform(found, f)


def windows(grams: Column, t: Column, threshold: float) -> Column:
    """The best window from each start: (dice, size, first, past, licence, k)."""

    def spans(flagged: Column) -> Column:
        flag = lambda i: F.coalesce(F.get(flagged, i), F.lit(False))
        at = F.sequence(F.lit(0), F.size(grams) - 1)
        ends = F.filter(at, lambda i: flag(i) & (~flag(i + 1) | (F.get(grams, i) == t["last"])))
        starts = F.filter(at, lambda i: flag(i) & ((i == 0) | ~flag(i - 1) | (F.get(grams, i) == t["first"])))
        return F.struct(starts.alias("starts"), ends.alias("ends"))

    def scored(start: Column, end: Column, part: Column) -> Column:
        shared = F.size(F.array_intersect(part, t["grams"]))
        dice = 2.0 * shared / (F.size(part) + F.size(t["grams"]))
        return F.struct(dice.alias("dice"), (end - start).alias("size"), start.alias("first"), end.alias("last"), t["licence"].alias("licence"), t["k"].alias("k"))

    def from_start(start: Column, ends: Column) -> Column:
        """Over the ends in order, until a window has more distinct bigrams than the bound:
        longer ones have no fewer."""
        none = F.struct(F.lit(False).alias("past"), F.lit(None).cast(WINDOW).alias("best"))

        def longer(so_far: Column, end: Column) -> Column:
            distinct = F.array_distinct(F.slice(grams, start + 1, end - start + 1))

            def tried(part: Column) -> Column:
                past = F.size(part) > t["hi"]
                best = F.when(past, so_far["best"]).otherwise(F.array_max(F.array(so_far["best"], scored(start, end, part))))
                return F.struct(past.alias("past"), best.alias("best"))

            return F.when(so_far["past"], so_far).otherwise(F.get(F.transform(F.array(distinct), tried), F.lit(0)))

        return F.aggregate(ends, none, longer, lambda so_far: so_far["best"])

    def best(s: Column) -> Column:
        near = lambda start: F.filter(s["ends"], lambda e: e - start + 1 >= t["lo"])
        return F.transform(s["starts"], lambda start: from_start(start, near(start)))

    found = chained(F.transform(grams, lambda g: among(g, t["buckets"])), each(spans), each(best))
    return F.filter(F.flatten(found), lambda w: w["dice"] >= threshold)


def unbeaten(found: Column) -> Column:
    """The windows that no better one of the same licence overlaps: one of a larger
    coefficient, of equal ones the longer, then the earlier, then the earlier template."""

    def beaten(w: Column, o: Column) -> Column:
        rank = lambda x: F.struct(-x["dice"], -x["size"], x["first"], x["k"])
        return (o["licence"] == w["licence"]) & (o["first"] <= w["last"]) & (w["first"] <= o["last"]) & (rank(o) < rank(w))

    return F.filter(found, lambda w: ~F.exists(found, lambda o: beaten(w, o)))


WINDOW = "struct<dice: double, size: int, first: int, last: int, licence: string, k: int>"
SHAPE = "array<struct<k: int, licence: string, lo: int, hi: int, first: string, last: string, grams: array<string>, buckets: array<array<string>>>>"


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, line, licence, dice) for each window of words that reaches the threshold.

    ``line``, from 1, is where the window starts. Of overlapping windows of a licence
    the best is given; windows of different licences may overlap. A null or empty text
    gives no rows; repeated rows give repeated results. Other columns are not read.
    ``templates`` is a short list and becomes part of the plan; one of a single word
    has no bigram and is never found. Time is linear in the text; a text that holds much
    of a long template in many pieces costs the square of the pieces.
    """
    shapes = shapes_of([t for t in templates if bigrams_in(t[1])], threshold)
    known = fixed([{**s, "buckets": hashed(s["grams"])} for s in shapes], SHAPE)
    marks = fixed(hashed(signatures(shapes)), "array<array<string>>")
    every = fixed(hashed(sorted({g for s in shapes for g in s["grams"]})), "array<array<string>>")

    def texts(text: Column) -> Column:
        """Words and, in a second list, each word's place among words and line ends."""
        pieces = F.split(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9\n]+", " "), r"\n", " \n "), " +")
        placed = F.filter(pieces, lambda w: w != "")
        at = F.filter(F.transform(placed, lambda w, i: F.when(w != "\n", i)), lambda i: i.isNotNull())
        return F.struct(F.filter(placed, lambda w: w != "\n").alias("words"), at.alias("at"))

    def paired(t: Column) -> Column:
        return F.struct(bigrams(t["words"]).alias("grams"), t["at"].alias("at"))

    def marked_by(t: Column) -> Column:
        held = F.array_distinct(F.filter(t["grams"], lambda g: among(g, every)))
        return F.struct(t["grams"], t["at"], held.alias("held"))

    def searched(t: Column) -> Column:
        held = lambda s: F.size(F.array_intersect(t["held"], s["grams"])) >= s["lo"]
        likely = F.filter(known, lambda s: F.when(F.size(t["held"]) >= s["lo"], held(s)).otherwise(False))
        found = F.flatten(F.transform(likely, lambda s: windows(t["grams"], s, threshold)))
        line = lambda w: F.get(t["at"], w["first"]) - w["first"] + 1
        named = lambda w: F.struct(line(w).alias("line"), w["licence"].alias("licence"), w["dice"].alias("dice"))
        return F.flatten(chained(found, each(unbeaten), each(lambda ws: F.transform(ws, named))))

    words = lambda text: F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), " ")
    likely = lambda grams: F.exists(grams, lambda g: among(g, marks))
    marked = chained(F.col("text"), each(words), each(bigrams), lambda found: F.filter(found, likely))
    text = F.when(F.size(marked) > 0, F.col("text"))
    hits = F.flatten(chained(text, lambda x: F.filter(x, lambda t: t.isNotNull()), each(texts), each(paired), each(marked_by), each(searched)))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    return rows.select("doc_id", F.explode(hits).alias("hit")).select("doc_id", "hit.line", "hit.licence", "hit.dice")


def sql(templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same for DuckDB, by joins and without the signatures."""
    shapes = shapes_of(templates, threshold)
    values = ", ".join(f"({s['k']}, '{s['licence']}', {s['lo']}, '{s['first']}', '{s['last']}', {s['grams']!r})" for s in shapes)
    return f"""
    WITH templates(k, licence, lo, head, tail, t) AS (VALUES {values}),
    pieces AS (
      SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split(replace(regexp_replace(lower(text), '[^a-z0-9\n]+', ' ', 'g'), chr(10), ' ' || chr(10) || ' '), ' '), lambda x: x <> '') AS p
      FROM documents WHERE text IS NOT NULL
    ), worded AS (
      SELECT rid, doc_id, list_filter(p, lambda x: x <> chr(10)) AS w, list_filter(range(1, len(p) + 1), lambda i: p[i] <> chr(10)) AS places FROM pieces
    ), grams AS (
      SELECT rid, doc_id, places, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g FROM worded WHERE len(w) > 1
    ), held AS (SELECT k, lo, head, tail, unnest(t) AS gram FROM templates),
    hits AS (
      SELECT rid, k, lo, pos, gram = head AS is_head, gram = tail AS is_tail, lag(pos) OVER run AS before, lead(pos) OVER run AS after
      FROM (SELECT rid, unnest(g) AS gram, generate_subscripts(g, 1) AS pos FROM grams) JOIN held USING (gram)
      WINDOW run AS (PARTITION BY rid, k ORDER BY pos)
    ), starts AS (SELECT rid, k, lo, pos AS a FROM hits WHERE is_head OR before IS DISTINCT FROM pos - 1),
    ends AS (SELECT rid, k, pos AS b FROM hits WHERE is_tail OR after IS DISTINCT FROM pos + 1),
    spans AS (SELECT rid, k, a, b FROM starts JOIN ends USING (rid, k) WHERE b - a + 1 >= lo),
    scored AS (
      SELECT rid, doc_id, k, licence, a, b, places[a] - a + 1 AS line,
        2.0::DOUBLE * len(list_intersect(g[a:b], t)) / (len(list_distinct(g[a:b])) + len(t)) AS dice
      FROM spans JOIN grams USING (rid) JOIN templates USING (k)
    ), good AS (SELECT * FROM scored WHERE dice >= {threshold})
    SELECT doc_id, CAST(line AS INTEGER) AS line, licence, dice FROM good w WHERE NOT EXISTS (
      SELECT 1 FROM good o WHERE o.rid = w.rid AND o.licence = w.licence AND o.a <= w.b AND w.a <= o.b
      AND (-o.dice, o.a - o.b, o.a, o.k) < (-w.dice, w.a - w.b, w.a, w.k))
    """


def op8_licences(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
