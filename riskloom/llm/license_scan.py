"""License scan by ordered signature rules, in DataFrame functions only.

A text is lower-cased (A to Z) and reduced to its words, one space apart. Three base phrases
are counted in it exactly. Then come the rules: for each license, regular expressions of the
ways to name it, each with a priority. Rules are gated twice by plain substrings: a text
needs a trigger word, and a license's rules run only if its keyword occurs. Every match
is a detection with a range of words. A detection is suppressed if another one's range
contains its own and has a higher priority, or the same priority and a longer range.

Matches become rows, so that positions and suppression are running sums and maxima within a
document, of whatever length; only texts with a match take part in that.

Defined results: a null or empty text has no words and no labels, and scores 0; repeated rows
get equal results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from riskloom.session import materialize

# Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# License, a word sequence it always comes with, and the ways to write its name.
FAMILIES = [
    ("mit", "mit", "mit"),
    ("mit", "expat", "expat"),
    ("x11", "x11", "x11"),
    ("isc", "isc", "isc"),
    ("zlib", "zlib", "zlib(?: libpng)?"),
    ("bsl-1.0", "boost", "boost(?: software)?"),
    ("apache-1.1", "apache", "apache(?: software)?(?: licen[cs]e)?(?: version)? 1 1"),
    ("apache-2.0", "apache", "apache(?: software)?(?: licen[cs]e)?(?: version)?(?: 2(?: 0)?)?"),
    ("bsd-2-clause", "bsd", "(?:simplified bsd|bsd 2 clause|2 clause bsd)"),
    ("bsd-2-clause", "freebsd", "freebsd"),
    ("bsd-3-clause", "bsd", "(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd)"),
    ("bsd-4-clause", "bsd", "(?:original bsd|bsd 4 clause|4 clause bsd)"),
    ("bsd", "bsd", "bsd(?: style)?"),
    ("gpl-2.0", "general public", "gnu general public licen[cs]e(?: gpl)?(?: version)? 2(?: 0)?"),
    ("gpl-3.0", "general public", "gnu general public licen[cs]e(?: gpl)?(?: version)? 3(?: 0)?"),
    ("gpl", "general public", "(?:gnu )?general public"),
    ("gpl-2.0", "gpl", "(?:gnu )?gpl (?:v|version )?2(?: 0)?"),
    ("gpl-2.0", "gplv2", "(?:gnu )?gplv2"),
    ("gpl-3.0", "gpl", "(?:gnu )?gpl (?:v|version )?3(?: 0)?"),
    ("gpl-3.0", "gplv3", "(?:gnu )?gplv3"),
    ("gpl", "gpl", "(?:gnu )?gpl"),
    ("lgpl", "lesser general public", "(?:gnu )?lesser general public(?: licen[cs]e)?(?: version)?(?: (?:2 1|3)(?: 0)?)?"),
    ("lgpl-2.1", "lgpl", "(?:gnu )?lgpl (?:v|version )?2 1"),
    ("lgpl-2.1", "lgplv2", "(?:gnu )?lgplv2(?: 1)?"),
    ("lgpl-3.0", "lgpl", "(?:gnu )?lgpl (?:v|version )?3(?: 0)?"),
    ("lgpl-3.0", "lgplv3", "(?:gnu )?lgplv3"),
    ("agpl-3.0", "affero", "(?:gnu )?affero general public(?: licen[cs]e)?(?: version)?(?: 3(?: 0)?)?"),
    ("agpl-3.0", "agpl", "(?:gnu )?agpl(?: (?:v|version )?3(?: 0)?)?"),
    ("gfdl", "documentation", "gnu free documentation"),
    ("mpl-1.1", "mozilla", "mozilla public(?: licen[cs]e)?(?: version)? 1 1"),
    ("mpl-2.0", "mozilla", "mozilla public(?: licen[cs]e)?(?: version)?(?: 2(?: 0)?)?"),
    ("epl", "eclipse", "eclipse public(?: licen[cs]e)?(?: version)?(?: [12](?: 0)?)?"),
    ("cddl-1.0", "common development", "common development and distribution"),
    ("eupl", "european union", "european union public"),
    ("artistic", "artistic", "artistic(?: licen[cs]e)?(?: [12] 0)?"),
    ("python-2.0", "python", "python(?: software foundation)?"),
    ("postgresql", "postgresql", "postgresql"),
    ("ruby", "ruby", "ruby"),
    ("vim", "vim", "vim"),
    ("ms-pl", "microsoft", "microsoft (?:public|reciprocal)"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)?"),
    ("ofl-1.1", "open font", "(?:sil )?open font"),
    ("odbl-1.0", "open database", "open database"),
    ("unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("cc0-1.0", "cc0", "cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-nc-nd", "cc by", "cc by nc nd(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "cc by", "cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc", "cc by", "cc by nc(?: [1-4] [05])?"),
    ("cc-by-nd", "cc by", "cc by nd(?: [1-4] [05])?"),
    ("cc-by-sa", "cc by", "cc by sa(?: [1-4] [05])?"),
    ("cc-by", "cc by", "cc by(?: [1-4] [05])?"),
    ("cc-by-nc", "creative commons", "creative commons attribution non ?commercial(?: [1-4] [05])?"),
    ("cc-by-sa", "creative commons", "creative commons attribution share ?alike(?: [1-4] [05])?"),
    ("cc-by", "creative commons", "creative commons attribution(?: [1-4] [05])?(?: international)?"),
]
# Way to name a license, its priority and how sure it is.
TEMPLATES = [
    ("spdx licen[cs]e identifier {}", 5, 1.0),
    ("(?:licen[cs]ed|released|distributed|published|available|provided) under (?:an? |the )?(?:terms of )?(?:the )?{}(?: licen[cs]e)?", 4, 0.95),
    ("dual licen[cs]ed? (?:under )?(?:the )?{}(?: licen[cs]e)?", 4, 0.9),
    ("(?:under )?(?:the )?terms (?:and conditions )?of (?:the )?{}(?: licen[cs]e)?", 3, 0.85),
    ("copy of (?:the )?{} licen[cs]e", 3, 0.8),
    ("licen[cs]ed? (?:as|with|by|type|name) {}", 3, 0.75),
    ("licen[cs]e {}", 2, 0.7),
    ("{} licen[cs]e", 2, 0.7),
]
#: Every rule's matches hold one of these.
TRIGGERS = [" licen", " spdx ", " under ", " terms ", " cc ", " cc0 ", " creative commons ", " public domain ", " rights reserved "]
PRIORITIES = range(1, 6)


def rules() -> list[tuple[str, list[tuple[str, str, int, float]]]]:
    """(keyword, [(label, expression, priority, weight)]) of all rules, by keyword."""
    by_keyword: dict[str, list[tuple[str, str, int, float]]] = {}
    for label, keyword, name in FAMILIES:
        own = by_keyword.setdefault(keyword, [])
        for template, priority, weight in TEMPLATES:
            own.append((label, template.format(f"(?:{name})"), priority, weight))
        if label.startswith("cc"):
            own.append((label, name, 1, 0.6))
    by_keyword["public domain"] = [
        ("public-domain", "(?:in|into|to|dedicated to) the public domain", 3, 0.8), ("public-domain", "public domain", 1, 0.4),
    ]
    by_keyword["rights reserved"] = [
        ("proprietary", "copyright (?:c )?(?:[0-9]{4} )?(?:[^ ]+ ){0,6}all rights reserved", 2, 0.6), ("reserved", "(?:all|no|some) rights reserved", 1, 0.5),
    ]
    return [
        (k, [(label, f"(?<= )(?:{rx})(?= )", p, w) for label, rx, p, w in own]) for k, own in by_keyword.items()
    ]


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" ")))


def word_text(text: str = "text") -> Column:
    """The words of a text in lower case, each with one space before and after; one space if there are none."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    low = F.translate(F.coalesce(F.col(text), F.lit("")), upper, upper.lower())
    words = F.trim(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(words == "", " ").otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def _base_columns() -> list[Column]:
    found, places, firsts, lasts = [], [], [], []
    n_words = F.col("n_words")
    for phrase, label in BASE.items():
        padded, size = F.lit(f" {phrase} "), phrase.count(" ") + 1
        there = F.contains("words", padded)
        found.append(F.when(there, F.lit(label)))
        places.append(F.when(there, F.regexp_count("words", F.lit(f"(?<= ){phrase}(?= )"))).otherwise(0))
        before = F.expr(f"substring(words, 1, instr(words, ' {phrase} '))")
        firsts.append(F.when(there, _spaces(before) - 1))
        after = F.substring_index("words", f" {phrase} ", -1)
        lasts.append(F.when(there, n_words - _spaces(after) - size))
    return [
        sum(places[1:], places[0]).cast("long").alias("n_base"), F.least(*firsts).cast("long").alias("first_word"),
        F.greatest(*lasts).cast("long").alias("last_word"), F.array_sort(F.array_compact(F.array(*found))).alias("base"),
    ]


def _rule_literal() -> Column:
    """All rules as one constant: an array of keywords with their rules."""
    return F.array(*(
        F.struct(F.lit(f" {keyword} ").alias("keyword"), F.array(*(
            F.struct(F.lit(label).alias("label"), F.lit(rx).alias("rx"), F.lit(p).alias("priority"), F.lit(w).alias("weight")) for label, rx, p, w in own
        )).alias("rules")) for keyword, own in rules()
    ))


def scan(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Base columns by row, and all detections (row, label, first word, end word, priority, weight)."""
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), word_text().alias("words"))
    words = words.withColumn("n_words", F.greatest(_spaces(F.col("words")) - 1, F.lit(0)).cast("long"))
    triggered = F.lit(False)
    for trigger in TRIGGERS:
        triggered = triggered | F.contains("words", F.lit(trigger))
    words = words.select("doc_id", "n_words", *_base_columns(), F.when(triggered, F.col("words")).alias("words"))
    near = F.filter(_rule_literal(), lambda k: F.contains("words", k["keyword"]))
    matched = F.transform(F.flatten(F.transform(near, lambda k: k["rules"])), lambda r: F.struct(
        r["label"].alias("label"), r["rx"].alias("rx"), r["priority"].alias("priority"), r["weight"].alias("weight"),
        F.transform(F.regexp_extract_all("words", r["rx"], F.lit(0)), _spaces).alias("spans"),
        F.transform(F.split(F.col("words"), r["rx"]), _spaces).alias("gaps"),
    ))
    hits = F.when(F.col("words").isNotNull(), F.filter(matched, lambda m: F.size(m["spans"]) > 0))
    rows = words.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", "n_base", "first_word", "last_word", "base", hits.alias("hits")
    )
    rows = materialize(rows, "license-hits")  # row numbers are fixed by this

    hit = rows.select("row", F.posexplode("hits").alias("rule", "hit"))
    each = hit.select("row", "rule", "hit.label", "hit.priority", "hit.weight", F.posexplode(
        F.arrays_zip(F.col("hit.spans").alias("span"), F.slice("hit.gaps", F.lit(1), F.size("hit.spans")).alias("gap"))
    ).alias("at", "m"))
    upto = Window.partitionBy("row", "rule").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    detections = each.select(
        "row", "label", "priority", "weight", (F.sum(F.col("m.gap") + F.col("m.span")).over(upto) - F.col("m.span") - 1).alias("first"), F.col("m.span").alias("span")
    ).withColumn("end", F.col("first") + F.col("span") + 1).drop("span")
    return rows.drop("hits"), detections


def unsuppressed(detections: DataFrame) -> DataFrame:
    """The detections that no other one contains and outranks."""
    same = detections.groupBy("row", "first", "end", "priority").agg(F.collect_set(F.struct("label", "weight")).alias("found"))
    before = Window.partitionBy("row").orderBy("first", F.desc("end"), F.desc("priority")).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.lit(None).cast("long")
    for p in PRIORITIES:
        reach = F.when(F.col("priority") == p, F.max(F.when(F.col("priority") >= p, F.col("end"))).over(before)).otherwise(reach)
    kept = same.withColumn("reach", reach).where(F.coalesce(F.col("reach") < F.col("end"), F.lit(True)))
    return kept.select("row", "first", "end", "priority", F.explode("found").alias("f")).select("row", "first", "end", "priority", "f.label", "f.weight")


def summarise(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """One row per document: base columns, labels of base and rules, and the surest detection as score."""
    found = kept.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("weight").alias("weight"))
    out = rows.join(found, "row", "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.greatest(F.coalesce("weight", F.lit(0.0)), F.when(F.col("n_base") > 0, F.lit(0.5)).otherwise(F.lit(0.0)))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"), score.alias("score"),
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, detections = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return summarise(rows, unsuppressed(detections))
