"""Names of products: extraction from titles, a catalog, matching of names against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gyeol.functions import text as T

#: What is taken off the end of a title, longest alternatives first.
SUFFIXES = ("요약 상품설명서", "상품설명서(핵심/요약)", "핵심설명서", "상품설명서", "계약권유문서", "서비스 설명서", "서비스설명서", "설명서", "기본약관", "이용약관", "약관")
QUOTED = "[『「](.+?)[』」]"
#: All brackets and document kinds at the end of a title at once.
TAILS = r"(?:\s*(?:[(（][^)）]*[)）]|" + "|".join(s.replace("(", r"\(").replace(")", r"\)") for s in SUFFIXES) + r"))+\s*$"
#: Names of the families that general terms stand for, by category.
FAMILIES = {"deposit": "예금", "loan": "대출", "digital_banking": "전자금융", "fx": "외환", "trust": "신탁·투자", "retirement_pension": "퇴직연금", "derivatives": "장외파생", "others": "기타"}
OVERLAP_LEAST = 4
GENERIC_DF = 10


def bare_title(c: Column) -> Column:
    """Without brackets and document kinds at the end, however many."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), TAILS, ""), r"^[ \-–—·]+|[ \-–—·]+$", "")


def usable_subtitle(c: Column) -> Column:
    """Short, no text run on, not a revision history."""
    return c.rlike(f"^[^(:][^:]{{0,{T.SUBTITLE_MAX - 1}}}$") & (F.regexp_count(c, F.lit("[0-9]")) <= F.length(c) * 0.3)


def product(c: Column) -> Column:
    """struct(name, granularity): what stands in corner brackets is a specific_product; else the
    longer of the bare head and a usable subtitle is a product_family, the head if equal."""

    def name(t: Column) -> Column:
        at = F.instr(t, F.lit(" - "))
        head = bare_title(F.when(at > 0, F.substr(t, F.lit(1), at - 1)).otherwise(t))
        tail = F.trim(F.substr(t, at + 3, F.length(t)))
        bare_tail = F.when((at > 0) & usable_subtitle(tail), bare_title(tail)).otherwise("")
        longer = T.let(F.struct(head.alias("h"), bare_tail.alias("t")), lambda x: F.when(F.length(x["t"]) > F.length(x["h"]), x["t"]).otherwise(x["h"]))
        quoted = F.trim(F.regexp_extract(t, QUOTED, 1))
        return F.when(t.rlike(QUOTED), F.struct(quoted.alias("name"), F.lit("specific_product").alias("granularity"))).otherwise(F.struct(longer.alias("name"), F.lit("product_family").alias("granularity")))

    return T.let(F.trim(F.coalesce(c, F.lit(""))), name)


def catalog(docs: DataFrame) -> DataFrame:
    """doc_id, bucket (product, family, general, or skipped_...), name, key of the documents outside
    the FAQ; latest and parsable ones with a title have a name, general terms that of the family of
    their category (the category itself if it has none)."""
    d = docs.where(F.coalesce("doc_type", F.lit("")) != "FAQ").withColumn("p", product(F.col("title")))
    general = ((F.col("doc_type") == "약관") & F.col("title").contains("약관")) | F.col("title").rlike("기본약관|이용약관")
    bucket = (
        F.when(~F.coalesce("is_parsable", F.lit(False)), "skipped_unparsable")
        .when(~F.coalesce("is_latest", F.lit(False)), "skipped_old")
        .when(T.filled(F.col("title")).isNull(), "skipped_untitled")
        .when(F.col("p.name") == "", "skipped_unnamed")
        .when(general, "general")
        .when(F.col("p.granularity") == "specific_product", "product")
        .otherwise("family")
    )
    family = F.col("category")
    for category, word in FAMILIES.items():
        family = F.when(F.col("category") == category, word).otherwise(family)
    name = F.when(bucket == "general", family).when(~bucket.startswith("skipped"), F.col("p.name"))
    return d.select("doc_id", bucket.alias("bucket"), name.alias("name"), T.catalog_key(name).alias("key"), "doc_type", "category")


def match_names(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """name, status (covered, ambiguous, unmatched, none), doc_id, n_candidates for asked (name)
    against entries (doc_id, key): the same key, else one key within the other, both of four
    characters or more; the first entry by id.

    Containment is an equi join: a key within another begins with one of the other's 4-character
    sequences, so keys meet on those only."""
    a = asked.select("name").distinct().withColumn("key", T.catalog_key(F.col("name")))
    e = entries.where(F.coalesce("key", F.lit("")) != "").groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 3, F.lit(1))), lambda i: F.substr(c, i, F.lit(4))))
    long_a, long_e = a.where(F.length("key") >= OVERLAP_LEAST), e.where(F.length("key") >= OVERLAP_LEAST)
    inside = long_a.withColumn("g", F.substring("key", 1, 4)).join(long_e.select(F.col("key").alias("ek"), "doc_id", F.explode(grams(F.col("key"))).alias("g")), "g")
    around = long_a.withColumn("g", F.explode(grams(F.col("key")))).join(long_e.select(F.col("key").alias("ek"), "doc_id", F.substring("key", 1, 4).alias("g")), "g")
    near = inside.where(F.contains("ek", "key")).select("name", "ek", "doc_id").union(around.where(F.contains("key", "ek")).select("name", "ek", "doc_id")).distinct()
    near = near.groupBy("name").agg(F.min("doc_id").alias("near_id"), F.count("*").alias("n"))
    j = a.join(e.withColumnRenamed("doc_id", "exact_id"), "key", "left").join(near, "name", "left")
    status = F.when(F.col("key") == "", "none").when(F.col("exact_id").isNotNull(), "covered").when(F.col("near_id").isNotNull(), "ambiguous").otherwise("unmatched")
    return j.select("name", status.alias("status"), F.when(F.col("key") != "", F.coalesce("exact_id", "near_id")).alias("doc_id"), F.coalesce("n", F.lit(0)).alias("n_candidates"))


def generic_tokens(names: DataFrame, least: int = GENERIC_DF) -> DataFrame:
    """token, df: tokens that too many names share to tell them apart. names: name."""
    t = names.select(F.explode(F.array_distinct(T.name_tokens(F.col("name")))).alias("token"))
    return t.groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") >= least)


def same_product(asked: Column, name: Column, generic: Column) -> Column:
    """Do both names have telling tokens, and is one key in the other or one token the other's prefix?
    generic: the array of tokens that tell nothing."""
    telling = lambda c: F.filter(T.name_tokens(c), lambda t: ~F.array_contains(generic, t))
    parts = F.struct(telling(asked).alias("a"), telling(name).alias("b"), T.catalog_key(asked).alias("ka"), T.catalog_key(name).alias("kb"))

    def decide(x: Column) -> Column:
        keys = (x["ka"] != "") & (x["kb"] != "") & (F.contains(x["kb"], x["ka"]) | F.contains(x["ka"], x["kb"]))
        prefix = F.exists(x["a"], lambda s: F.exists(x["b"], lambda t: F.startswith(s, t) | F.startswith(t, s)))
        return (F.size(x["a"]) > 0) & (F.size(x["b"]) > 0) & (keys | prefix)

    return T.let(parts, decide)


def n_distinct_products(keys: Column) -> Column:
    """How many of the keys, in order, neither begin nor are begun by one counted before."""
    seen = lambda acc, k: F.exists(acc, lambda x: F.startswith(x, k) | F.startswith(k, x))
    step = lambda acc, k: F.when((k == "") | seen(acc, k), acc).otherwise(F.concat(acc, F.array(k)))
    return F.size(F.aggregate(keys, F.array().cast("array<string>"), step))


def product_verdict(asked: Column, hits: Column, cited_names: Column, n_products: Column, all_hits: Column, only_terms: Column) -> Column:
    """pass, fail or na. hits: which cited names are of the product asked; all_hits: the same over all
    evidence; only_terms: evidence is terms and FAQ only."""
    true = lambda a: F.exists(a, lambda x: x)
    return (
        F.when(F.size(cited_names) == 0, "na")
        .when(F.coalesce(F.trim(asked), F.lit("")) == "", F.when(n_products >= 2, "fail").otherwise("na"))
        .when(F.forall(hits, lambda x: x), "pass")
        .when(true(hits) | true(all_hits), "fail")
        .when(only_terms, "na")
        .otherwise("fail")
    )


ANALYSIS = "product string, product_granularity string, can_answer_with_general_terms string, requires_product_specific_doc string, confidence string"


def query_analysis(raw: Column) -> Column:
    """A model's JSON as typed columns: unknown granularities are none, confidence is clamped, any
    non-empty value but false and 0 is true; broken JSON gives the defaults."""
    j = F.from_json(raw, ANALYSIS, {"mode": "PERMISSIVE"})
    truth = lambda c: F.coalesce(~F.lower(F.trim(c)).isin("", "false", "0", "null"), F.lit(False))
    kind = F.when(j["product_granularity"].isin("specific_product", "product_family", "none"), j["product_granularity"]).otherwise("none")
    conf = F.least(F.greatest(F.coalesce(F.try_to_number(j["confidence"], F.lit("9.999")).cast("double"), j["confidence"].try_cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return F.struct(T.filled(j["product"]).alias("product"), kind.alias("granularity"), truth(j["can_answer_with_general_terms"]).alias("general"), truth(j["requires_product_specific_doc"]).alias("specific"), conf.alias("confidence"))


def coverage_refusal(analysis: Column, status: Column) -> Column:
    """ambiguous_product, product_mismatch or null; what passes is asked before what refuses."""
    passes = (analysis["granularity"] == "none") | analysis["general"] | ~analysis["specific"] | (status == "covered")
    return F.when(passes, None).when(status == "ambiguous", "ambiguous_product").when(status == "unmatched", "product_mismatch")
