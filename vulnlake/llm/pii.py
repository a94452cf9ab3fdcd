"""Personal data: base spans by pattern, and terms that reveal them by information theory.

Base spans are e-mail addresses, IP addresses, payment cards and telephone numbers. Each value is a protected entity. Its context
is the whole of every document that names it, sentence by sentence; a word discloses an entity if seeing it says much about the
entity: the pointwise mutual information of word and entity, over the sentences of the corpus, reaches a share of the entity's
own information content. Sightings are discounted by n / (n + 1), as a word that stands in one sentence of the corpus goes with
anything there; every entity is rated, also one that a single document names. Such words are added as spans of kind ``term``
wherever they stand in a document of that entity. Copies of a text count once. A null text is an empty one; equal rows (same id
and text) get equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.llm.common import lower_ascii, prefix_sums, table, without, written

KINDS = ("email", "ip", "card", "phone")
BROADCAST_COPIES = 200_000
#: Between sentences.
SENTENCE = r"(?<=[.!?])[\x20\t\r]+|[\r\n]+"
#: A start in the middle of a run of the same characters can only match what its beginning matches, so starts are run
#: beginnings (or the end of the last match), and repeats are possessive where nothing follows them: long runs take linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Texts without these hold no match.
NEEDED = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string,value:string>>"


def matches(text: Column, pattern: str) -> Column:
    """(start, end, value) of the matches, leftmost and without overlap, in code points."""
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    gaps = F.slice(pieces, F.lit(1), F.size(found))
    before = prefix_sums(F.zip_with(gaps, found, lambda p, m: (F.length(p) + F.length(m)).cast("bigint")))
    starts = F.zip_with(before, gaps, lambda b, p: b + F.length(p))
    return F.zip_with(starts, found, lambda s, m: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), m.alias("value")))


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        digit = F.ascii(F.substr(back, i, F.lit(1))) - 48
        twice = digit * 2
        return total + F.when(i % 2 == 1, digit).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        def small(part: Column) -> Column:
            bare = F.regexp_replace(part, "^0+", "")
            return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))
        return F.forall(F.split(value, r"\."), small)
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """All base spans by start, then kind as listed."""
    return F.sort_array(F.concat(*[_spans_of(kind, rank, text) for rank, kind in enumerate(KINDS)]))


def _spans_of(kind: str, rank: int, text: Column) -> Column:
    spans = F.transform(F.filter(matches(text, PATTERNS[kind]), lambda m: _holds(kind, m["value"])), lambda m: F.struct(
        m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"), m["value"].alias("value")))
    needed = text.contains("@") if kind == "email" else text.rlike(NEEDED[kind])
    return F.when(needed, spans).otherwise(F.array().cast(SPAN))


def digest_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def blanked(text: Column, spans: Column) -> Column:
    """The text with spaces in the place of the spans, so that all else keeps its place."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def put(state: Column, span: Column) -> Column:
        gap = F.substr(text, (state["at"] + 1).cast("int"), F.greatest(F.lit(0), span["start"] - state["at"]).cast("int"))
        blank = F.repeat(F.lit(" "), F.greatest(F.lit(0), span["end"] - F.greatest(state["at"], span["start"])).cast("int"))
        return F.struct(F.concat(state["out"], gap, blank).alias("out"), F.greatest(state["at"], span["end"]).alias("at"))

    return F.aggregate(spans, start, put, lambda s: F.concat(s["out"], F.substr(text, (s["at"] + 1).cast("int"), F.length(text))))


def find_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", disclosure: float = 0.6, term: str = r"\p{L}{4,}+") -> DataFrame:
    """(doc_id, _text, base, spans), one row per document: base spans, and these with the disclosing terms.

    A term needs ``disclosure`` times the entity's information content. ``_text`` is a hash of the text.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(whole).alias("_text"), whole.alias("_whole"), base_spans(whole).alias("base"))
    rows = written(rows.select("doc_id", "_text", "base", F.when(F.size("base") > 0, blanked(F.col("_whole"), F.col("base"))).otherwise(
        F.col("_whole")).alias("body")), "personal")
    # Texts with personal data, one row for each; only these are searched again, and no whole text goes into the last join.
    own = written(rows.filter(F.size("base") > 0).select("_text", "base", "body").dropDuplicates(["_text"]), "owners")
    revealing = _disclosing(rows, own, disclosure, term)
    inside = F.filter(matches(F.col("body"), term), lambda m: F.array_contains("terms", lower_ascii(m["value"])))
    extra = F.transform(inside, lambda m: F.struct(
        m["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), m["end"].alias("end"), F.lit("term").alias("kind"), m["value"].alias("value")))
    added = own.join(revealing, "_text").select(F.col("_text").alias("_t"), extra.alias("extra"))
    joined = rows.select("doc_id", "_text", "base").join(added, F.col("_text") == F.col("_t"), "left")
    return joined.select("doc_id", "_text", "base", F.sort_array(F.concat("base", F.coalesce("extra", F.array().cast(SPAN)))).alias("spans"))


def _disclosing(rows: DataFrame, own: DataFrame, disclosure: float, term: str) -> DataFrame:
    """(_text, terms): the terms that disclose an entity of a text, from (_text, base, body) of all rows and of texts with base spans."""
    sentences = F.split(lower_ascii(F.col("body")), SENTENCE, -1)
    seen = F.flatten(F.transform(sentences, lambda s: F.array_distinct(F.regexp_extract_all(s, F.lit(term), F.lit(0)))))
    # The entities of each text, with the sentences of all their texts.
    own = written(own.select("_text", F.array_distinct(F.transform("base", lambda s: F.sha2(F.concat(s["kind"], F.lit(":"), F.lower(s["value"])), 256))).alias(
        "entities"), F.size(sentences).cast("bigint").alias("n_s"), seen.alias("seen")), "entities")
    owners = own.select("_text", "n_s", F.explode("entities").alias("entity"))
    entities = written(owners.groupBy("entity").agg(F.sum("n_s").alias("n_e"), F.count("*").alias("texts")), "entities")
    # Sentences with a term over the whole corpus, counted with map-side reduction; a text with n copies counts as n n-ths.
    copied = written(rows.groupBy("_text").agg(F.count("*").alias("n")).filter("n > 1").withColumnRenamed("_text", "_t"), "copies")
    small = copied.count() <= BROADCAST_COPIES
    once = rows.join(F.broadcast(copied) if small else copied, F.col("_text") == F.col("_t"), "left").withColumn("w", 1 / F.coalesce("n", F.lit(1)))
    most = entities.agg(F.max("n_e").alias("n_e")).first()["n_e"]
    n_s = once.agg(F.sum(F.col("w") * F.size(sentences)).alias("n_s")).first()["n_s"]
    if most is None:
        return rows.limit(0).select("_text", F.array().cast("array<string>").alias("terms"))
    n_s = F.lit(float(round(n_s)))

    def may_reach(n_e: Column) -> Column:  # what holds of a term that stands in no sentence without the entity
        return (F.col("n_t") / (F.col("n_t") + 1) >= disclosure) & (F.log2(n_s / F.col("n_t")) >= disclosure * F.log2(n_s / n_e))

    counts = (once.select("w", F.explode(seen).alias("term")).groupBy("term").agg(F.round(F.sum("w")).alias("n_t"))
              .filter(may_reach(F.lit(float(most)))))
    found = own.select("_text", F.explode("seen").alias("term")).groupBy("_text", "term").agg(F.count("*").alias("k")).join(counts, "term")
    pairs = found.join(owners.join(entities, "entity").select("_text", "entity", "n_e", "texts"), "_text").filter(may_reach(F.col("n_e")))

    def reaches(n_te: Column) -> Column:
        content = F.log2(n_s / F.col("n_e"))
        return (content > 0) & (n_te / (n_te + 1) * F.log2(n_te / F.col("n_e") * n_s / F.col("n_t")) >= disclosure * content)

    # The sightings of an entity with one text are known before they are added up.
    pairs = pairs.filter((F.col("texts") > 1) | reaches(F.col("k")))
    rated = pairs.groupBy("entity", "term").agg(F.sum("k").alias("n_te"), F.first("n_t").alias("n_t"), F.first("n_e").alias("n_e"))
    terms = written(rated.filter(reaches(F.col("n_te"))).groupBy("entity").agg(F.collect_set("term").alias("terms")), "terms")
    return owners.join(terms, "entity").groupBy("_text").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))


def sanitise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents with every span generalised to its kind in brackets, and the spans found as ``spans``.

    Spans that overlap are replaced together, named after the first.
    """
    found = find_spans(docs, doc_id, text, **options).select(F.col("doc_id").alias("_id"), F.col("_text").alias("_t"), F.col("spans").alias("_spans")).distinct()
    rows = without(docs, ["spans"])
    whole = F.coalesce(F.col(text), F.lit(""))
    joined = rows.join(found, F.col(doc_id).eqNullSafe(F.col("_id")) & (F.xxhash64(whole) == F.col("_t")), "left")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def put(state: Column, span: Column) -> Column:
        gap = F.substr(whole, (state["at"] + 1).cast("int"), (span["start"] - state["at"]).cast("int"))
        return F.when(span["start"] >= state["at"], F.struct(
            F.concat(state["out"], gap, F.lit("["), span["kind"], F.lit("]")).alias("out"), span["end"].alias("at"))).otherwise(
            F.struct(state["out"].alias("out"), F.greatest(state["at"], span["end"]).alias("at")))

    cleaned = F.aggregate("_spans", start, put, lambda s: F.concat(s["out"], F.substr(whole, (s["at"] + 1).cast("int"), F.length(whole))))
    return joined.withColumn(text, F.when(F.size("_spans") > 0, cleaned).otherwise(F.col(text))).withColumn(
        "spans", digest_text(F.col("_spans"))).drop("_id", "_t", "_spans")


def op9_personal_data(spark, folder):
    found = find_spans(table(spark, folder, "documents").select("doc_id", "text"))
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(digest_text(F.col("base")), 256).alias("base_sha256"),
                        digest_text(F.col("spans")).alias("spans"))
