"""Personal data: four kinds by pattern, and the terms around them that would give them away.

The base spans are emails, IP addresses, card and phone numbers. The protected entities are their distinct values. How
strongly a term reveals an entity is measured on the whole corpus: the pointwise mutual information of finding the term
in a text with the entity, as a share of the entity's own information. A term that is in at least `MIN_DOCS` texts with
the entity and discloses at least `GENERALISE` of it is telling: wherever it stands, in texts without the entity too, it
becomes a span of its own and is replaced by its class, or taken out from `REMOVE` on. What a term discloses most counts.
Base spans are always replaced by their kind, and what touches them is no term: terms are looked for in the text with its
base spans masked.

The search goes from the entities outwards, each step over what the one before found: entities in enough texts, terms of
their texts, pairs, the number of all texts that hold those terms, and last the positions of telling terms in the texts
that hold one. Where nothing is found the rest is not run, as nothing can be telling.

Only column expressions and SQL are used. Positions are running sums over the cuts of a text, so the work grows with
its length and not with its square. Patterns use possessive groups and start only where a leftmost match can start,
which finds the same matches without backtracking.

Defined results: null or empty text has no span; its digest is that of the empty string. Rows repeated are separate
texts. Null ids are kept. Extra columns are ignored. An empty table gives no rows. Spans overlap across kinds if the
patterns do; when a text is rewritten, what an earlier span has covered is not written again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voltrail.session import written

KINDS = ("email", "ip", "card", "phone")
LOCAL = "A-Za-z0-9._%+-"
# The leftmost match of the first two patterns starts behind the last match or at the start of a run of its characters.
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MIN_DOCS = 3
MASK = "\uFFFC"
GENERALISE, REMOVE = 0.5, 0.75
# Three letters or digits and more, hyphens and apostrophes between them, in quotes or brackets or not.
OPENING, CLOSING = r"\"'(\[{<«„“‘»", r".,;:!?\"')\]}>»”’“«"
TERM = rf"(?<![^\s{OPENING}])(?=[\p{{L}}\p{{N}}'’-]{{3}})[\p{{L}}\p{{N}}]++(?:['’-][\p{{L}}\p{{N}}]++)*+(?=[{CLOSING}]*+(?:\s|$))"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether 13 to 19 digits end in their check digit."""
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)), F.lit(0),
        lambda sum_, i: sum_ + _luhn_digit(F.ascii(F.substring(digits, F.length(digits) - i + 1, F.lit(1))) - 48, i),
    )
    return F.when(F.length(digits).between(13, 19), total % 10 == 0).otherwise(False)


def _luhn_digit(digit: Column, place: Column) -> Column:
    twice = digit * 2
    return F.when(place % 2 == 1, digit).otherwise(F.when(twice > 9, twice - 9).otherwise(twice)).cast("int")


def _is_valid(kind: Column, match: Column) -> Column:
    digits = _digits(match)
    byte = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", match.rlike(rf"^{byte}(?:\.{byte}){{3}}$"))
        .when(kind == "card", _luhn(digits))
        .otherwise(F.length(digits).between(9, 15))
    )


def _cuts(kind: str, text: Column) -> Column:
    """The kind's matches in a text, each with the text between it and the match before, and what surrounds it."""
    sign = {"email": "@", "phone": "+"}.get(kind)
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    has = F.contains(text, F.lit(sign)) if sign else text.rlike("[0-9]")
    matches = F.when(has, found)
    pieces = F.split(text, PATTERNS[kind], -1)

    def cut(match: Column, i: Column) -> Column:
        before = F.get(F.col(f"_pieces_{kind}"), i)
        return F.struct(
            F.lit(kind).alias("kind"), i.alias("nr"), match.alias("match"), F.length(before).alias("gap"),
        )

    return matches, pieces, cut


def base_spans(docs: DataFrame) -> DataFrame:
    """text_nr, doc_id, text_key, kind, start, end, entity: a row per match, and one for texts without.

    Matches that fail their check count for the positions behind them and are then without kind, so every text stays.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("text_nr"), "doc_id", text.alias("text"), text_key().alias("text_key"))
    cutters = {kind: _cuts(kind, F.col("text")) for kind in KINDS}
    rows = rows.withColumns({f"_found_{k}": c[0] for k, c in cutters.items()})
    rows = rows.withColumns({f"_pieces_{k}": F.when(F.size(f"_found_{k}") > 0, c[1]) for k, c in cutters.items()})
    cuts = F.concat(*[F.coalesce(F.transform(f"_found_{k}", c[2]), F.array()) for k, c in cutters.items()])
    rows = rows.select("text_nr", "doc_id", "text_key", F.explode_outer(cuts).alias("c")).select(
        "text_nr", "doc_id", "text_key", "c.*")
    order = Window.partitionBy("text_nr", "kind").orderBy("nr").rowsBetween(Window.unboundedPreceding, 0)
    length = F.length("match")
    end = F.sum(F.col("gap") + length).over(order)
    valid = F.coalesce(_is_valid(F.col("kind"), F.col("match")), F.lit(False))
    entity = F.when(F.col("kind") == "email", F.lower("match")).when(F.col("kind") == "ip", F.col("match")) \
        .otherwise(_digits(F.col("match")))
    rows = rows.withColumn("end", end.cast("long")).withColumn("start", F.col("end") - length)
    return rows.select(
        "text_nr", "doc_id", "text_key", F.when(valid, F.col("kind")).alias("kind"), "start", "end",
        F.when(valid, F.concat_ws(":", "kind", entity)).alias("entity"),
    )


def text_key() -> Column:
    """128 bits that stand for a text."""
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(text_key().alias("text_key"), "text")


def masked(texts: DataFrame, *more: str) -> DataFrame:
    """text_key and `masked`: the text with every code point of a base span replaced, kind by kind in their order."""
    rows = texts.select("text_key", *more, F.coalesce("text", F.lit("")).alias("masked"))
    for kind in KINDS:
        sign = {"email": "@", "phone": "+"}.get(kind)
        has = F.contains("masked", F.lit(sign)) if sign else F.col("masked").rlike("[0-9]")
        hidden = lambda match, kind=kind: F.when(
            F.coalesce(_is_valid(F.lit(kind), match), F.lit(False)), F.repeat(F.lit(MASK), F.length(match))).otherwise(match)
        pieces = F.zip_with(
            F.split("masked", PATTERNS[kind], -1), F.regexp_extract_all("masked", F.lit(PATTERNS[kind]), F.lit(0)),
            lambda piece, match: F.concat(piece, F.coalesce(hidden(match), F.lit(""))))
        rows = rows.withColumn("masked", F.when(has, F.array_join(pieces, "")).otherwise(F.col("masked")))
    return rows


def _distinct_terms(rows: DataFrame) -> DataFrame:
    """text_key, term: each distinct term of each row's text, without positions."""
    terms = F.array_distinct(F.transform(F.regexp_extract_all("masked", F.lit(TERM), F.lit(0)), F.lower))
    return rows.select("text_key", F.explode(terms).alias("term"))


def _once(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """text_key, masked: the texts of these keys, each once."""
    return masked(_keyed(docs).join(keys, "text_key", "left_semi").dropDuplicates(["text_key"]))


TELLING = "entity string, term string, disclosure double"
PLACED = "text_key binary, term string, start long, end long, disclosure double"


def disclosures(docs: DataFrame, spans: DataFrame, min_docs: int = MIN_DOCS, generalise: float = GENERALISE) -> DataFrame:
    """entity, term, disclosure: the share of the entity's information that the term discloses, where it is enough.

    From the entities outwards: only entities in `min_docs` texts are paired, only with the terms of texts that hold
    them, and only the terms of such pairs are counted in all texts. A text counts as often as it occurs.
    """
    spark, total = docs.sparkSession, docs.count()
    none = spark.createDataFrame([], TELLING)
    with_entity = spans.where("kind IS NOT NULL").select("entity", "text_key", "text_nr").distinct().groupBy(
        "entity", "text_key").agg(F.count(F.lit(1)).alias("copies"))
    with_entity = written(with_entity, "pii-entities")
    entities = with_entity.groupBy("entity").agg(F.sum("copies").alias("entity_texts")).where(
        F.col("entity_texts").between(min_docs, total - 1))
    entities = written(entities, "pii-entities")
    if entities.isEmpty():
        return none
    paired = with_entity.join(entities, "entity").select("entity", "text_key", "copies")
    held = written(_distinct_terms(_once(docs, paired.select("text_key").distinct())), "pii-held")
    pairs = paired.join(held, "text_key").groupBy("entity", "term").agg(F.sum("copies").alias("together")).where(
        F.col("together") >= min_docs)
    pairs = written(pairs.join(entities, "entity"), "pii-pairs")
    if pairs.isEmpty():
        return none
    counts = _distinct_terms(masked(_keyed(docs))).groupBy("term").agg(F.count(F.lit(1)).alias("texts"))
    known = pairs.join(counts, "term")
    mutual = F.log2(F.lit(float(total)) * F.col("together") / (F.col("entity_texts") * F.col("texts")))
    share = mutual / F.log2(F.lit(float(total)) / F.col("entity_texts"))
    return known.select("entity", "term", share.alias("disclosure")).where(F.col("disclosure") >= generalise)


def placed_terms(docs: DataFrame, telling: DataFrame) -> DataFrame:
    """text_key, term, start, end, disclosure: where the telling terms stand in each distinct text.

    Only texts that hold one are cut into words with positions.
    """
    most = written(telling.groupBy("term").agg(F.max("disclosure").alias("disclosure")), "pii-telling")
    if most.isEmpty():
        return docs.sparkSession.createDataFrame([], PLACED)
    holders = _distinct_terms(masked(_keyed(docs))).join(most, "term").distinct().groupBy("text_key").agg(
        F.map_from_entries(F.collect_list(F.struct("term", "disclosure"))).alias("telling"))
    texts = _keyed(docs).join(written(holders, "pii-holders"), "text_key").dropDuplicates(["text_key"])
    words = F.regexp_extract_all("masked", F.lit(TERM), F.lit(0))
    gaps = F.transform(F.split("masked", TERM, -1), F.length)
    rows = masked(texts, "telling").select(
        "text_key", "telling", F.posexplode(F.arrays_zip(words.alias("word"), gaps.alias("gap"))).alias("nr", "w")).where(
        "w.word IS NOT NULL").select("text_key", "nr", "w.word", "w.gap", F.element_at("telling", F.lower("w.word")).alias("disclosure"))
    # The texts are dealt by key already, so their words stay where they are.
    order = Window.partitionBy("text_key").orderBy("nr").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.length("word")).over(order).cast("long")).where("disclosure IS NOT NULL")
    return rows.select(
        "text_key", F.lower("word").alias("term"), (F.col("end") - F.length("word")).alias("start"), "end", "disclosure")


def find_personal_data(docs: DataFrame, min_docs: int = MIN_DOCS, generalise: float = GENERALISE) -> DataFrame:
    """doc_id, text_key, n_email, n_ip, n_card, n_phone, base_sha256, spans, found: a row per text.

    `found` has kind, start, end, entity-free, sorted as in `spans`; terms carry their disclosure.
    """
    spans = written(base_spans(docs), "pii-spans")
    telling = written(disclosures(docs, spans, min_docs, generalise), "pii-disclosures")
    placed = written(placed_terms(docs, telling), "pii-terms")
    terms = placed.join(spans.select("text_nr", "text_key").distinct(), "text_key")
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    base = spans.select(
        "text_nr", "doc_id", "text_key", F.when(F.col("kind").isNotNull(), order).alias("order"), "kind", "start", "end",
        F.lit(None).cast("double").alias("disclosure"))
    more = terms.select(
        "text_nr", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("text_key"),
        F.lit(len(KINDS) + 1).alias("order"), F.lit("term").alias("kind"), "start", "end", "disclosure")
    span = F.when(F.col("kind").isNotNull(), F.struct("order", "start", "end", "kind", "disclosure"))
    texts = base.unionByName(more).groupBy("text_nr").agg(
        F.max("doc_id").alias("doc_id"), F.max("text_key").alias("text_key"),
        F.array_sort(F.collect_list(span)).alias("found"),
    )

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")

    def joined(which: Column) -> Column:
        return F.array_join(F.transform(which, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    only_base = F.filter("found", lambda x: x["kind"] != "term")
    return texts.select(
        "doc_id", "text_key", *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(F.encode(joined(only_base), "UTF-8"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), "found",
    )


def sanitise(docs: DataFrame, min_docs: int = MIN_DOCS, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """doc_id, sanitised: the texts with every span replaced by its class, or taken out."""
    found = find_personal_data(docs, min_docs, generalise).select("doc_id", "text_key", "found").dropDuplicates(
        ["doc_id", "text_key"])
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), text_key().alias("text_key"))
    rows = rows.alias("d").join(found.alias("f"), F.expr("d.doc_id <=> f.doc_id AND d.text_key = f.text_key")).select(
        "d.doc_id", "d.text", "f.found")
    ordered = F.array_sort(F.transform("found", lambda x: F.struct(
        x["start"].alias("start"), (-x["end"]).alias("back"), x["kind"].alias("kind"), x["disclosure"].alias("disclosure"))))

    def step(done: Column, span: Column) -> Column:
        end = -span["back"]
        mark = F.when(end <= done["at"], "").when(span["kind"] != "term", F.concat(F.lit("["), F.upper(span["kind"]), F.lit("]"))) \
            .when(span["disclosure"] >= remove, "").otherwise("[TERM]")
        gap = F.greatest(span["start"] - done["at"], F.lit(0))
        kept = F.substring(F.col("text"), (done["at"] + 1).cast("int"), gap.cast("int"))
        return F.struct(F.concat(done["out"], kept, mark).alias("out"), F.greatest(done["at"], end).alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    rest = lambda done: F.concat(done["out"], F.substring(F.col("text"), (done["at"] + 1).cast("int"), F.length("text")))
    return rows.select("doc_id", F.aggregate(ordered, start, step, rest).alias("sanitised"))


def personal_data_digests(docs: DataFrame) -> DataFrame:
    """doc_id, the four counts, base_sha256 and spans."""
    return find_personal_data(docs).drop("text_key", "found")
