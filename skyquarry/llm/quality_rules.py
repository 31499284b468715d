r"""Quality rules: counts for each document, and the divergence of its histograms from references of languages.

Two histograms of a document are compared with references by the Jensen-Shannon distance (base 2, 0 to 1): characters by
class (CLASSES), and how often each common word of a language stands among all words (COMMON and "other"). The reference of
a language holds the mean shares over all documents whose lang it is, of whatever language and however few they are. Texts
whose lang is null are compared with all documents of their kind of script, with cased letters or without. Languages
without a list of common words, and texts without a language, have no distance of common words (0).

A document is kept if its base rules pass and neither distance is too large. Histograms of short texts scatter, so both
limits have a term that falls with the words, and a distance only counts from a least number of words. The limit for a text
with fewer common words than its reference is a share of the distance that a text without any would have. DataFrame
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, carried, computed, join_small, table, words_col, written

MIN_WORDS = 50
#: Shortest documents, in words, whose character classes and common words are compared.
MIN_FOR_CLASSES, MIN_FOR_COMMON = 50, 100
#: Largest class distance of a kept document of n words: MAX_CLASSES + SHORT / n.
MAX_CLASSES, SHORT = 0.24, 4.0
#: Largest distance of common words: MAX_COMMON, and for texts with fewer common words than their reference, FAR +
#: SCATTER / sqrt(n) of the distance of a text without any.
MAX_COMMON, FAR, SCATTER = 0.38, 0.4, 5.0
#: Fixed value: the symbols counted in n_symbols.
SYMBOLS = "#*$%&|<>"
#: Classes by their characters, where these are few. Letters are "lower" (without capitals, marks on them included) or
#: "upper" in all scripts; the rest are "other".
CLASSES = {"digit": "0123456789", "stop": ".,;:", "call": "!?", "quote": "\"'()[]{}", "dash": "-_/\\+=~^`@", "symbol": SYMBOLS}
N_CLASSES = len(CLASSES) + 4
#: Letters beyond a-z, as parts of a pattern's class: without capitals, capitals, and of scripts that have no case.
LOWER, UPPER, UNCASED = r"\p{Ll}\p{Lo}\p{Lm}\p{M}", r"\p{Lu}\p{Lt}", r"\p{Lo}\p{M}"
#: The most common words of languages, lower-cased.
COMMON = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "ist"],
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "for", "was", "on", "with"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"],
    "it": ["di", "e", "il", "la", "che", "in", "un", "per", "del", "non", "con", "una"],
    "pt": ["de", "a", "o", "que", "e", "do", "da", "em", "um", "para", "com", "os"],
}
#: Longest words, marks included, that are looked at for common ones.
SHORT_WORD = 6
N_COMMON = max(map(len, COMMON.values()))


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with q_text, its q_words, and q_rest: all characters but a-z and white space. Null texts count as empty."""
    df = computed(docs, {"q_text": F.coalesce(F.col(text), F.lit("")), "q_words": words_col(F.col(text))})
    return computed(df, {"q_rest": F.regexp_replace("q_text", r"[a-z\x20\t-\r]+", ""), "q_size": F.length("q_text"), "q_in_words": F.length(F.array_join("q_words", ""))})


def base() -> dict[str, Column]:
    """Counts of a text with features()."""
    lines = F.filter(F.split("q_text", "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return {
        "n_words": F.size("q_words").cast("long"),
        "word_chars": F.col("q_in_words").cast("long"),
        "n_symbols": (F.length("q_rest") - F.length(F.translate("q_rest", SYMBOLS, ""))).cast("long"),
        "n_dup_lines": F.when(F.contains("q_text", F.lit("\n")), _once(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))).otherwise(0).cast("long"),
    }


def repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more: O(n log n) in the words.

    Windows are compared by 64-bit hashes within a document. Most documents repeat none, which a set of the hashes shows.
    Otherwise the hashes are sorted with their places; equal neighbours mark repeated windows; each place, in order, adds
    the words up to the next place, three at most.
    """
    n, none = F.size(words), F.lit(0).cast("long")
    most = F.greatest(n - 2, F.lit(0))
    triples = F.arrays_zip(F.slice(words, 1, most).alias("a"), F.slice(words, 2, most).alias("b"), F.slice(words, 3, most).alias("c"))
    hashes = F.transform(triples, lambda x: F.xxhash64(x["a"], x["b"], x["c"]))
    counted = _once(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(_once(_places(h), _covered)))
    return F.when(n < 4, none).otherwise(counted)


def _once(value: Column, then) -> Column:
    """then(value), where value is computed once however often `then` names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _places(hashes: Column) -> Column:
    """Places, rising, of hashes that stand elsewhere too."""
    def marked(s: Column) -> Column:
        most = F.greatest(F.size(s) - 1, F.lit(0))
        none = F.array(F.lit(None).cast("long"))
        near = F.arrays_zip(s.alias("s"), F.slice(s["h"], 2, most).alias("n"), F.concat(none, F.slice(s["h"], 1, most)).alias("p"))
        return F.transform(F.filter(near, lambda x: (x["s"]["h"] == x["n"]) | (x["s"]["h"] == x["p"])), lambda x: x["s"]["i"])

    return F.sort_array(_once(F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), marked))


def _covered(places: Column) -> Column:
    after = F.concat(F.slice(places, 2, F.greatest(F.size(places) - 1, F.lit(0))), F.array(F.lit(1 << 30)))
    gaps = F.zip_with(places, after, lambda x, y: F.least(y - x, F.lit(3)).cast("long"))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)


def _among(chars: str) -> Column:
    """How many characters of q_rest are in a pattern's class."""
    return F.length("q_rest") - F.length(F.regexp_replace("q_rest", f"[{chars}]+", ""))


def class_shares() -> Column:
    """Array of the shares of character classes in a text with features(); zeros for an empty one."""
    size = F.col("q_size")
    spaces = size - F.col("q_in_words")
    each = [size - spaces - F.length("q_rest") + _among(LOWER), _among(UPPER), spaces]
    each += [F.length("q_rest") - F.length(F.translate("q_rest", chars, "")) for chars in CLASSES.values()]
    other = size
    for x in each:
        other = other - x
    return F.array(*(F.coalesce(x / F.nullif(size, F.lit(0)), F.lit(0.0)) for x in [*each, other]))


def common_counts(words: Column, lang: Column) -> Column:
    """How often each common word of the language stands among the words of SHORT_WORD characters or fewer, without case
    and marks; empty for a language without a list."""
    short = F.array_join(F.filter(words, lambda x: F.length(x) <= SHORT_WORD), " ")
    # two spaces between words, so that a word's neighbours don't share one
    plain = F.concat(F.lit(" "), F.regexp_replace(F.lower(short), r"[\s.,;:!?\"'()\[\]*#$%&|<>]+", "  "), F.lit(" "))
    asked = F.array().cast("array<string>")
    for k, ws in COMMON.items():
        asked = F.when(lang == k, F.array(*(F.lit(f" {w} ") for w in ws))).otherwise(asked)
    counts = _once(plain, lambda s: F.transform(asked, lambda w: (F.length(s) - F.length(F.replace(s, w, F.lit("")))) / F.length(w)))
    return F.when(lang.isin(*COMMON), counts).otherwise(F.array().cast("array<double>"))


def measured(docs: DataFrame) -> DataFrame:
    """docs (text, lang and others) with the base counts, q_classes, q_counts and q_key, the name of its reference."""
    df = features(docs)
    words = F.col("q_words")
    uncased = 2 * _among(UNCASED) > F.col("q_in_words")
    key = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.when(uncased, "uncased").otherwise("cased"))
    script = F.when(uncased, "uncased").otherwise("cased")
    df = computed(df, base() | {"n_repeat_words": repeat_words(words), "q_classes": class_shares(), "q_counts": common_counts(words, F.col("lang")), "q_key": key, "q_script": script})
    return df.drop("q_text", "q_words", "q_rest", "q_size", "q_in_words")


def references(df: DataFrame) -> DataFrame:
    """(q_key, r_classes, r_common, r_none), written: a row for each language and kind of script of measured() documents.

    r_common are the shares of a language's common words and of the rest, null without a list; r_none is the distance of a
    text without common words.
    """
    sums = {f"c{i}": F.sum(F.when(F.col("n_words") > 0, F.element_at("q_classes", i + 1))) for i in range(N_CLASSES)}
    sums |= {f"k{i}": F.sum(F.get("q_counts", i)) for i in range(N_COMMON)}
    sums |= {"docs": F.count_if(F.col("n_words") > 0), "n": F.sum("n_words")}
    both = written(df.groupBy("q_key", "q_script").agg(*(c.alias(k) for k, c in sums.items())), "quality-sums")
    every = both.filter(F.startswith("q_key", F.lit("="))).unionByName(both.withColumn("q_key", F.col("q_script")))
    one = every.groupBy("q_key").agg(*(F.sum(k).alias(k) for k in sums)).filter("docs > 0")
    classes = F.array(*(F.col(f"c{i}") / F.col("docs") for i in range(N_CLASSES)))
    own = F.array(*(F.col(f"k{i}") / F.col("n") for i in range(N_COMMON)))
    common = F.when(F.col("q_key").isin(*(f"={k}" for k in COMMON)), _with_rest(own))
    one = one.select("q_key", classes.alias("r_classes"), common.alias("r_common"))
    none = F.array(*([F.lit(0.0)] * N_COMMON), F.lit(1.0))
    return written(one.withColumn("r_none", distance(none, F.col("r_common"))), "quality-references")


def _with_rest(shares: Column) -> Column:
    total = F.aggregate(shares, F.lit(0.0), lambda a, x: a + x)
    return F.concat(shares, F.array(F.greatest(1 - total, F.lit(0.0))))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares."""
    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    terms = F.zip_with(p, q, lambda x, y: part(x, (x + y) / 2) + part(y, (x + y) / 2))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def judged(df: DataFrame, known: DataFrame) -> DataFrame:
    """measured() documents with class_distance, common_distance, base_failed and kept.

    Null and empty texts have no words and fail the base rules. Each row is judged by itself, so repeated rows have the
    same result and there are no ties; a distance at its limit is kept. A null lang is none of the languages.
    """
    n = F.col("n_words")
    df = join_small(df, known, "q_key", "left", spread="word_chars")
    shares = _with_rest(F.transform("q_counts", lambda x: x / F.greatest(n, F.lit(1))))
    listed = F.col("r_common").isNotNull() & (F.size("q_counts") > 0)
    common = F.when(listed, distance(shares, F.col("r_common"))).otherwise(0.0)
    fewer = listed & (F.element_at(shares, -1) > F.element_at("r_common", -1))
    df = computed(df, {"class_distance": F.round(F.coalesce(distance(F.col("q_classes"), F.col("r_classes")), F.lit(0.0)), 6), "common_distance": F.round(common, 6), "q_fewer": F.coalesce(fewer, F.lit(False))})
    failed = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * n)
    far = (n >= MIN_FOR_CLASSES) & (F.col("class_distance") > MAX_CLASSES + SHORT / n)
    limit = F.round((FAR + SCATTER / F.sqrt(n)) * F.coalesce("r_none", F.lit(0.0)), 6)
    strange = (n >= MIN_FOR_COMMON) & ((F.col("common_distance") > MAX_COMMON) | (F.col("q_fewer") & (F.col("common_distance") > limit)))
    df = df.withColumn("base_failed", failed).withColumn("kept", ~failed & ~far & ~strange)
    return df.drop("q_classes", "q_counts", "q_key", "q_script", "q_fewer", "r_classes", "r_common", "r_none")


def kept_documents(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """docs without those that the rules reject. Texts are measured once, and written with their measures.

    Null and empty texts have no words and are rejected; equal rows are judged alike; columns keep their names, whatever
    these are. An empty table stays empty.
    """
    df = written(measured(carried(docs, text=text, lang=lang)).drop("text", "lang"), "quality-measures")
    return judged(df, references(df)).filter("kept").select("doc_.*")


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "common_distance"]


def op7_quality_rules(spark, sf_dir):
    """A row for each row of documents. Counts are of whole texts, however long; columns beyond the first seven are extra.

    Null texts have no words. Repeated rows count again in the references and are judged alike; limits themselves are kept. Only
    the columns named are read, so others may have any names; an empty table gives an empty result.
    """
    docs = table(spark, sf_dir, "documents")
    df = written(measured(docs.select("doc_id", "text", "lang")).drop("text"), "quality-measures")
    return judged(df, references(df)).select("doc_id", *COLUMNS)


def _sql() -> str:
    """The same in DuckDB's SQL, windows and histograms by unnesting."""
    text = lambda x: "'" + x.replace("'", "''") + "'"
    esc = lambda chars: "".join("\\" + c if c in "\\]^-[" else c for c in chars)
    among = lambda chars: f"(length(t) - length(regexp_replace(t, {text('[' + chars + ']')}, '', 'g')))"
    classes = [among(LOWER), among(UPPER), "(length(t) - word_chars)", *(among(esc(c)) for c in CLASSES.values())]
    asked = " ".join(f"WHEN lang = {text(k)} THEN [{', '.join(text(f' {w} ') for w in ws)}]" for k, ws in COMMON.items())
    jsd = lambda p, q: f"sqrt(greatest(list_sum(list_transform(list_zip({p}, {q}), lambda x: (CASE WHEN x[1] > 0 THEN x[1] * log2(x[1] / ((x[1] + x[2]) / 2)) ELSE 0 END) + (CASE WHEN x[2] > 0 THEN x[2] * log2(x[2] / ((x[1] + x[2]) / 2)) ELSE 0 END))) / 2, 0))"
    known = ", ".join(text(f"={k}") for k in COMMON)
    none = "[" + "0.0::DOUBLE, " * N_COMMON + "1.0::DOUBLE]"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT *, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, {among(esc(SYMBOLS))}::BIGINT AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
  ' ' || regexp_replace(lower(array_to_string(list_filter(w, lambda x: length(x) <= {SHORT_WORD}), ' ')), '[\s.,;:!?"''()\[\]*#$%&|<>]+', '  ', 'g') || ' ' AS plain,
  CASE {asked} END AS asked FROM d),
m AS (SELECT *, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, list_transform([{', '.join(classes)}], lambda x: CASE WHEN length(t) > 0 THEN x / length(t)::DOUBLE ELSE 0 END) AS c0,
  CASE WHEN 2 * {among(UNCASED)} > word_chars THEN 'uncased' ELSE 'cased' END AS script,
  list_transform(asked, lambda a: (length(plain) - length(replace(plain, a, ''))) / length(a)::DOUBLE) AS k FROM b),
e AS (SELECT *, coalesce('=' || lang, script) AS key, list_append(c0, CASE WHEN length(t) > 0 THEN (length(t) - list_sum([{', '.join(classes)}])) / length(t)::DOUBLE ELSE 0 END) AS c FROM m),
p AS (SELECT uid, unnest(range(1, n_words - 1)) AS i, w FROM b WHERE n_words >= 3),
g AS (SELECT uid, i, count(*) OVER (PARTITION BY uid, w[i], w[i + 1], w[i + 2]) AS n FROM p),
r AS (SELECT uid, count(DISTINCT i + o) AS n_repeat_words FROM g, (VALUES (0), (1), (2)) AS x(o) WHERE n > 1 GROUP BY uid),
u AS (SELECT key AS of, * FROM e WHERE lang IS NOT NULL UNION ALL SELECT script AS of, * FROM e),
s AS (SELECT of, [{', '.join(f'avg(CASE WHEN n_words > 0 THEN c[{i + 1}] END)' for i in range(N_CLASSES))}] AS rc,
  CASE WHEN of IN ({known}) THEN [{', '.join(f'sum(k[{i + 1}]) / sum(n_words)' for i in range(N_COMMON))}] END AS rk FROM u GROUP BY of HAVING sum(n_words) > 0),
z AS (SELECT of, rc, CASE WHEN rk IS NOT NULL THEN list_append(rk, greatest(0, 1 - list_sum(rk))) END AS rk FROM s),
f AS (SELECT e.*, rc, rk, list_append(list_transform(k, lambda x: x / greatest(n_words, 1)), greatest(0, 1 - list_sum(list_transform(k, lambda x: x / greatest(n_words, 1))))) AS sh FROM e LEFT JOIN z ON z.of = e.key),
h AS (SELECT uid, round(coalesce({jsd('c', 'rc')}, 0), 6)::DOUBLE AS class_distance, CASE WHEN rk IS NOT NULL THEN round({jsd('sh', 'rk')}, 6) ELSE 0 END::DOUBLE AS common_distance,
  coalesce(sh[-1] > rk[-1], FALSE) AS fewer, round(({FAR} + {SCATTER} / sqrt(n_words::DOUBLE)) * coalesce({jsd(none, 'rk')}, 0), 6) AS lim FROM f),
o AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, class_distance, common_distance, fewer, lim FROM e LEFT JOIN r USING (uid) LEFT JOIN h USING (uid))
SELECT * EXCLUDE (fewer, lim), (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND NOT ((n_words >= {MIN_FOR_CLASSES} AND class_distance > {MAX_CLASSES} + {SHORT} / n_words::DOUBLE)
    OR (n_words >= {MIN_FOR_COMMON} AND (common_distance > {MAX_COMMON} OR (fewer AND common_distance > lim)))) AS kept FROM o"""


OP7_SQL = _sql()
