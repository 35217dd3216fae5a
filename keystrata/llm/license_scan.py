"""Licence scans: TF-IDF cosine of headers, licence files and licence statements to templates,
inherited along directories.

A unit is a run of consecutive paragraphs that speak of licences (`CUE`), comment marks and line
breaks removed, wherever it stands: a file header, a README's last section. The whole text is a unit
of files that a name or a third of their paragraphs makes a licence file. Units are term vectors,
(1 + ln tf) idf without everyday words, joined with those of the full texts in `licenses`.

As an addition, a statement is a sentence or line that holds a word which templates rarely share; without such a
word the cosine to any template stays below the threshold (`Weights.cues` makes sure of that). Its
words, weighted by term frequency and the templates' inverse document frequency, are compared to
every short template at once; statements that are wrapped over lines count where units hold them. A
file has the licence of its best unit or statement, a longer unit's where a statement names another
one ("All rights reserved." in a BSD text). A licence file, one whose name says so or whose
unit or statements are FILE_SHARE of its words at least, gives its licence to its
directory, and files without a licence take that of the nearest directory above them that has one.

Only DataFrame operations. Scale: one scan finds units and statements; equal ones are scored once, so
a line that a third of all files hold is one row; templates are constants in the expressions, and of
full texts a table of some thousand words;
ancestors are looked up per directory, not per file; joins are plain ones that Spark can split.

Defined results: null and empty texts have no licence of their own; null paths inherit nothing;
ties go to the template that is listed first and the licence file whose path is smallest; repeated
rows give repeated rows; other columns are ignored; an empty table gives an empty table.
"""

import json
import math
import re
from collections import Counter
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

THRESHOLD = 0.7
FILE_SHARE = 0.1
WORD = r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*"
LICENSE_NAME = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"
#: Short public licence notices.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("All-Rights-Reserved", "All rights reserved."),
]
#: Template words that ordinary text is full of, the last to be cues.
COMMON = {"a", "an", "and", "are", "as", "at", "be", "by", "for", "form", "from", "in", "is", "it", "not", "of", "on", "or", "that", "the", "this", "to", "use", "v", "was", "with", "without"}
#: Full texts and file headers of licences, NAME.text.txt and NAME.header.txt.
FULL_TEMPLATES = [(p.name.rsplit(".", 2)[0], p.read_text()) for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))]
#: What a paragraph that belongs to a licence speaks of.
CUE = r"(?i)licen[cs]|copyright|warrant|redistribut|permission|rights reserved|liabilit"
_LINE_MARK = r"#|//|--|;|%|dnl\b|REM\b"
_MARKS = r"(?m)^[ \t]*(?:/\*+!?|\*+/?|//+!?|#+!?|--+|;+|%+|<!--|\"{3}|'{3}|>|dnl\b|REM\b)[ \t]*"


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+(?:[.-][^\W_]+)*", text.lower())


class Weights:
    """The templates' unit vectors, and the weight of any word."""

    def __init__(self, templates=TEMPLATES):
        self.names = [name for name, _ in templates]
        counts = [Counter(words_of(text)) for _, text in templates]
        self.df = Counter(w for c in counts for w in c)
        self.unseen = self.idf(0)
        raw = [{w: n * self.idf(self.df[w]) for w, n in c.items()} for c in counts]
        self.vectors = [{w: x / math.sqrt(sum(y * y for y in v.values())) for w, x in v.items()} for v in raw]

    def idf(self, df: int) -> float:
        return math.log((1 + len(self.names)) / (1 + df)) + 1

    def cues(self, threshold: float) -> tuple[list[str], list[list[str]]]:
        """(words, sets of words): a statement without any of the words, and without all words of
        any of the sets, reaches the threshold for no template. A cosine is at most the length of
        the template's part over the words that are shared; where everyday words alone could be
        long enough, those are a set that it could not do without."""
        words, sets, least = set(), [], threshold * threshold * 0.999
        for v in self.vectors:
            rest = sum(x * x for x in v.values())
            for w in sorted(v.keys() - COMMON, key=lambda w: (w[0].isdigit(), self.df[w], -len(w), w)):
                if rest < least:
                    break
                words.add(w)
                rest -= v[w] ** 2
            if rest >= least:
                needed = sorted(w for w in v.keys() & COMMON if rest - v[w] ** 2 < least)
                if needed:
                    sets.append(needed)
                else:
                    words |= v.keys() & COMMON
        return sorted(words), sets


def _one_of(words: list[str]) -> str:
    return "(?:" + "|".join(re.escape(c) for c in words) + ")"


def _can_reach(statement: Column, weights: Weights, threshold: float) -> Column:
    """Whether a bound on the cosine reaches the threshold. Dot products add up by occurrences; the
    statement's length is at least what it were if no word came twice."""
    rows = {w: [weights.idf(n) ** 2, *[weights.idf(n) * v.get(w, 0.0) for v in weights.vectors]] for w, n in sorted(weights.df.items())}
    numbers = lambda x: F.array(*[F.lit(float(y)) for y in x])
    table = F.create_map(*[x for w, row in rows.items() for x in (F.lit(w), numbers(row))])
    unseen = numbers([weights.unseen**2] + [0] * len(weights.names))
    words = F.regexp_extract_all(F.lower(statement), F.lit(f"({WORD})"), 1)
    sums = F.aggregate(words, numbers([0] * (1 + len(weights.names))), lambda so_far, w: F.zip_with(so_far, F.coalesce(F.try_element_at(table, w), unseen), lambda a, b: a + b))
    best = F.array_max(F.slice(sums, 2, len(weights.names)))
    return best * best >= sums[0] * (threshold * threshold * 0.999)


def _statements(text: Column, weights: Weights, threshold: float) -> Column:
    """Distinct sentences and lines that hold a cue word, or all words of a set, and may reach the threshold."""
    cues = weights.cues(threshold)
    holds = lambda u, words: F.regexp_like(u, F.lit(r"(?i)(?<![\p{L}\p{N}])" + _one_of(words) + r"(?![\p{L}\p{N}])"))

    def is_cued(u):
        found = holds(u, cues[0])
        for together in cues[1]:
            found = found | reduce(lambda a, b: a & b, [holds(u, [w]) for w in together])
        return found

    units = F.split(F.regexp_replace(text, r"([.!?])[ \t]+", "$1\n"), "\n")
    return F.array_distinct(F.filter(units, lambda u: is_cued(u) & _can_reach(u, weights, threshold)))


def _units(text: Column) -> Column:
    """Runs of consecutive paragraphs that speak of licences, and the whole text where they are a third of it."""
    t = F.regexp_replace(text, r"(?:\*/|-->|\"{3}|'{3})(?=[ \t\r]*\n)", "\n\n")
    t = F.regexp_replace(t, rf"(?m)^([ \t]*({_LINE_MARK}).*)\r?\n(?![ \t]*\2)", "$1\n\n")  # code follows a comment
    paragraphs = F.filter(F.split(F.regexp_replace(t, _MARKS, ""), r"\n(?:[ \t\r]*\n)+"), lambda p: F.regexp_like(p, F.lit(WORD)))
    marked = F.transform(paragraphs, lambda p: F.when(F.regexp_like(p, F.lit(CUE)), F.regexp_replace(p, "\u0001", " ")).otherwise("\u0001"))
    runs = F.filter(F.split(F.array_join(marked, "\n"), "\u0001"), lambda r: F.trim(F.regexp_replace(r, r"\s+", " ")) != "")
    whole = F.size(F.filter(marked, lambda p: p != "\u0001")) * 3 >= F.size(marked)
    return F.array_distinct(F.transform(F.when(whole, F.concat(runs, F.array(text))).otherwise(runs), lambda r: F.trim(F.regexp_replace(r, r"\s+", " "))))


def _terms(texts: DataFrame, column: str) -> DataFrame:
    """(id, word, tf) of distinct texts. What is made for each of a text's words is its id only, not
    the text, and ids are taken before: else the work would grow with the square of a text's length."""
    found = texts.select(column).distinct().select(F.md5(column).alias("id"), F.regexp_extract_all(F.lower(column), F.lit(f"({WORD})"), 1).alias("found"))
    return found.select("id", F.explode("found").alias("word")).groupBy("id", "word").agg(F.count(F.lit(1)).alias("tf"))


def _best(templates: int, first: int) -> Column:
    """struct(cosine, minus the template's number) of the best of the dot products d0, d1 and so on."""
    length = F.sqrt(F.nullif(F.col("square"), F.lit(0.0)))  # of everyday words only: no cosine
    cosines = [F.round(F.col(f"d{i}") / length, 6) for i in range(templates)]
    none = F.lit(None).cast("struct<cosine: double, which: int>")
    return F.array_max(F.array(none, *[F.struct(c.alias("cosine"), F.lit(-i - first).alias("which")) for i, c in enumerate(cosines)])).alias("best")


def unit_scores(units: DataFrame, templates, threshold: float, first: int) -> DataFrame:
    """(id, best, words): best is struct(cosine, minus the template's number) of distinct units that reach the threshold."""
    counts = [{w: n for w, n in Counter(words_of(text)).items() if w not in COMMON} for _, text in templates]
    df = Counter(w for c in counts for w in c)
    idf = lambda n: math.log((1 + len(templates)) / (1 + n)) + 1
    raw = [{w: (1 + math.log(n)) * idf(df[w]) for w, n in c.items()} for c in counts]
    known = {w: {"word": w, "idf": idf(n), "v": [0.0] * len(templates)} for w, n in df.items()}
    for i, v in enumerate(raw):
        length = math.sqrt(sum(x * x for x in v.values()))
        for w, x in v.items():
            known[w]["v"][i] = x / length
    rows = F.from_json(F.lit(json.dumps(list(known.values()))), "array<struct<word: string, idf: double, v: array<double>>>")
    vocabulary = units.sparkSession.range(1).select(F.inline(rows))

    terms = _terms(units, "unit").join(F.broadcast(vocabulary), "word", "left")
    weight = F.when(F.col("word").isin(*sorted(COMMON)), 0.0).otherwise((1 + F.log("tf")) * F.coalesce("idf", F.lit(idf(0))))
    terms = terms.withColumn("w", weight)
    dots = [F.sum(F.col("w") * F.col("v")[i]).alias(f"d{i}") for i in range(len(templates))]
    sums = terms.groupBy("id").agg(F.sum("tf").alias("words"), F.sum(F.col("w") * F.col("w")).alias("square"), *dots)
    return sums.select("id", _best(len(templates), first), "words").where(F.col("best.cosine") >= threshold)


def statement_scores(statements: DataFrame, weights: Weights) -> DataFrame:
    """(id, best, words): best is struct(cosine, minus the template's number) of distinct statements."""
    terms = _terms(statements, "statement")
    by_word = F.create_map(*[x for w in sorted(weights.df) for x in (F.lit(w), F.array(F.lit(weights.idf(weights.df[w])), *[F.lit(float(v.get(w, 0.0))) for v in weights.vectors]))])
    none = F.array(F.lit(weights.unseen), *[F.lit(0.0)] * len(weights.names))
    terms = terms.withColumn("v", F.coalesce(F.try_element_at(by_word, F.col("word")), none)).withColumn("w", F.col("tf") * F.col("v")[0])
    sums = terms.groupBy("id").agg(F.sum("tf").alias("words"), F.sum(F.col("w") * F.col("w")).alias("square"), *[F.sum(F.col("w") * F.col("v")[i + 1]).alias(f"d{i}") for i in range(len(weights.names))])
    return sums.select("id", _best(len(weights.names), 0), "words")


def scan_licenses(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, file_share: float = FILE_SHARE, full_templates=FULL_TEMPLATES) -> DataFrame:
    """(doc_id, path, own_license, cosine, license, inherited_from) for every row of files(doc_id, path, text)."""
    weights = Weights(templates)
    name = F.array(*[F.lit(n) for n in [*weights.names, *[n for n, _ in full_templates]]])
    f = files.select(F.col("doc_id").cast("long"), F.col("path").cast("string"), F.col("text").cast("string"))
    f = f.withColumn("file", F.md5(F.concat_ws("\u0001", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("path", F.lit("")), F.md5(F.coalesce("text", F.lit(""))))))
    none = F.array().cast("array<string>")
    f = f.withColumn("statements", F.coalesce(_statements(F.col("text"), weights, threshold), none))
    named = F.when(F.regexp_like("path", F.lit(LICENSE_NAME)), F.array(F.trim(F.regexp_replace("text", r"\s+", " "))))
    units = F.when(F.regexp_like("text", F.lit(CUE)), F.array_union(_units(F.col("text")), F.coalesce(named, none)))
    f = f.withColumn("units", F.coalesce(units, none))
    sentences = F.array_distinct(F.flatten(F.transform("units", lambda u: _statements(u, weights, threshold))))
    f = f.withColumn("wrapped", F.array_except(sentences, F.col("statements")))
    n_words = F.when((F.size("statements") > 0) | (F.size("units") > 0), F.regexp_count("text", F.lit(WORD))).alias("n_words")
    # what is found is far smaller than the text, which is so read once
    f = written(f.select("doc_id", "path", "file", "statements", "wrapped", "units", n_words), "license-statements")
    found = f.where("n_words is not null").select("file", "path", "n_words", "statements", "wrapped", "units").dropDuplicates(["file"])
    lines = found.select("file", F.explode("statements").alias("statement"), F.lit(False).alias("wrapped"))
    lines = lines.unionByName(found.select("file", F.explode("wrapped").alias("statement"), F.lit(True).alias("wrapped")))
    scores = statement_scores(lines, weights).where(F.col("best.cosine") >= threshold)
    plain, wrapped = ~F.col("wrapped"), F.col("wrapped")
    by_line = lines.withColumn("id", F.md5("statement")).join(scores, "id").groupBy("file").agg(F.max("best").alias("best"), F.coalesce(F.sum(F.when(plain, F.col("words"))), F.sum(F.when(wrapped, F.col("words")))).alias("words"))
    whole = found.select("file", F.explode("units").alias("unit"))
    by_unit = whole.withColumn("id", F.md5("unit")).join(unit_scores(whole, full_templates, threshold, len(weights.names)), "id")
    by_unit = by_unit.groupBy("file").agg(F.max("best").alias("best"), F.max("words").alias("words"))
    called = lambda c: F.element_at(name, 1 - F.col(f"{c}.which"))
    own = by_line.toDF("file", "line", "line_words").join(by_unit.toDF("file", "unit", "unit_words"), "file", "full").join(found.select("file", "path", "n_words"), "file")
    # a phrase of a longer text that is another licence does not speak for it
    phrase = (called("line") != called("unit")) & (F.col("line_words") < F.col("unit_words"))
    own = own.withColumn("best", F.when(phrase, F.col("unit")).otherwise(F.greatest("line", "unit"))).withColumn("words", F.greatest("line_words", "unit_words"))
    # read by the licence files and by the result
    own = own.select("file", "path", called("best").alias("own_license"), F.col("best.cosine").alias("cosine"), (F.col("words") / F.col("n_words")).alias("share"))
    own = written(own, "license-own")

    directory = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    given = own.where((F.col("share") >= file_share) | F.regexp_like("path", F.lit(LICENSE_NAME)))
    given = given.groupBy(directory.alias("above")).agg(F.min(F.struct((-F.col("cosine")).alias("order"), "path", "own_license")).alias("by")).select("above", F.col("by.own_license").alias("given"))
    d = f.where(F.col("path").isNotNull()).select(directory.alias("directory")).distinct()
    parts = F.split("directory", "/")
    above = F.transform(F.sequence(F.lit(0), F.when(F.col("directory") == "", 0).otherwise(F.size(parts))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    d = d.select("directory", F.explode(above).alias("above")).join(given, "above")
    d = d.groupBy("directory").agg(F.max_by(F.struct("above", "given"), F.length("above")).alias("near"))

    out = f.select("doc_id", "path", "file", directory.alias("directory")).join(own.select("file", "own_license", "cosine"), "file", "left").join(d, "directory", "left")
    inherits = F.col("own_license").isNull()
    return out.select("doc_id", "path", "own_license", "cosine", F.coalesce("own_license", F.col("near.given")).alias("license"), F.when(inherits, F.col("near.above")).alias("inherited_from"))


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree: sources, in them languages, in them directories of a hundred ids."""
    source, lang, doc_id = F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.col("doc_id").cast("string")
    file = F.concat(doc_id, F.lit(".txt"))
    path = F.when(F.col("doc_id") % 50 == 0, F.concat_ws("/", source, file)).when(F.col("doc_id") % 10 == 0, F.concat_ws("/", source, lang, file))
    path = path.otherwise(F.concat_ws("/", source, lang, F.floor(F.col("doc_id") / 100).cast("string"), file))
    return docs.select("doc_id", F.when(F.col("doc_id").isNotNull(), path).alias("path"), "text")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(document_files(table(spark, sf_dir, "documents")))


def _sql() -> str:
    weights = Weights()
    rows = ", ".join(f"('{w}', {weights.idf(n)!r}::DOUBLE, [{', '.join(repr(float(v.get(w, 0.0))) for v in weights.vectors)}]::DOUBLE[])" for w, n in sorted(weights.df.items()))
    words, sets = weights.cues(THRESHOLD)
    matches = lambda some: rf"regexp_matches(s, '(?i)(^|[^\p{{L}}\p{{N}}])({'|'.join(c.replace('.', chr(92) + '.') for c in some)})([^\p{{L}}\p{{N}}]|$)')"
    cued = " OR ".join([matches(words), *("(" + " AND ".join(matches([w]) for w in together) + ")" for together in sets)])
    names = "[" + ", ".join(f"'{n}'" for n in weights.names) + "]"
    n = len(weights.names)
    none = "[" + ", ".join(["0.0"] * n) + "]::DOUBLE[]"
    best = "greatest(" + ", ".join(f"struct_pack(cosine := round(d[{i + 1}] / sqrt(square), 6), which := {-i})" for i in range(n)) + ")"
    dots = "[" + ", ".join(f"sum(w * v[{i + 1}])" for i in range(n)) + "]"
    return rf"""
WITH f AS (SELECT doc_id, coalesce(text, '') AS text, CASE
    WHEN doc_id % 50 = 0 THEN concat(coalesce(source, 'none'), '/', doc_id, '.txt')
    WHEN doc_id % 10 = 0 THEN concat(coalesce(source, 'none'), '/', coalesce(lang, 'none'), '/', doc_id, '.txt')
    ELSE concat(coalesce(source, 'none'), '/', coalesce(lang, 'none'), '/', doc_id // 100, '/', doc_id, '.txt') END AS path FROM documents),
d AS (SELECT *, regexp_extract(path, '^(.*)/[^/]*$', 1) AS directory FROM f),
u AS (SELECT doc_id, path, text, unnest(list_distinct(list_filter(string_split(regexp_replace(text, '([.!?])[ \t]+', '\1' || chr(10), 'g'), chr(10)),
    lambda s: {cued}))) AS statement FROM f),
t AS (SELECT statement, word, count(*) AS tf FROM (SELECT statement, unnest(regexp_extract_all(lower(statement), '{WORD}')) AS word
    FROM (SELECT DISTINCT statement FROM u)) GROUP BY ALL),
k(word, idf, v) AS (VALUES {rows}),
x AS (SELECT statement, tf, tf * coalesce(idf, {weights.unseen!r}::DOUBLE) AS w, coalesce(v, {none}) AS v FROM t LEFT JOIN k USING (word)),
s AS (SELECT statement, sum(tf) AS words, sum(w * w) AS square, {dots} AS d FROM x GROUP BY statement),
b AS (SELECT statement, words, {best} AS best FROM s),
own AS (SELECT doc_id, path, max(best) AS best, sum(words) / len(regexp_extract_all(any_value(text), '{WORD}')) AS share
  FROM u JOIN b USING (statement) WHERE best.cosine >= {THRESHOLD} GROUP BY doc_id, path),
o AS (SELECT doc_id, path, {names}[1 - best.which] AS own_license, best.cosine AS cosine, share FROM own),
g AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS above, arg_min(own_license, struct_pack(c := -cosine, p := path)) AS given
  FROM o WHERE share >= {FILE_SHARE} GROUP BY 1),
a AS (SELECT DISTINCT directory FROM d),
n AS (SELECT directory, arg_max(struct_pack(above := above, given := given), length(above)) AS near
  FROM a JOIN g ON above = directory OR above = '' OR starts_with(directory, above || '/') GROUP BY directory)
SELECT d.doc_id, d.path, own_license, cosine, coalesce(own_license, near.given) AS license,
  CASE WHEN own_license IS NULL THEN near.above END AS inherited_from
FROM d LEFT JOIN o ON d.path = o.path LEFT JOIN n ON d.directory = n.directory
"""


OP2_SQL = _sql()
