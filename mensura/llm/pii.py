"""PII (3): bootstrapped contextual extraction, in DataFrame operations only.

Base matches of four kinds are the seeds. The words around a seed induce lexical patterns
(the word before, the two words before, the word after). Patterns and instances, seeds and
all other tokens with a digit or @ (neighbouring tokens of digits are one), form a graph that is scored in rounds: a pattern's score for
a kind is the smoothed share of its instances' confidence, an instance's confidence the
noisy-or of its patterns' scores. Tokens of high confidence are spans too; base spans stay.

Only matches are shuffled, never texts. Positions come from cumulated lengths of the parts
that a pattern splits a text into, by a window over the text's matches, so a text with many
matches costs no more than they do.

Null and empty texts have no spans. Repeated rows have the same spans each. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mensura.llm.common import beside, materialize, read

#: The base kinds in order with their patterns, written so that none can backtrack over a run.
KINDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A token that could be an identifier: it has a digit or @.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
_DIGITS = r"[()+./-]*+[0-9][0-9()./-]*+"
#: Neighbouring tokens of digits, as of a phone in groups.
RUN = rf"(?<![^\x20\x09-\x0D]){_DIGITS}(?:[\x20\x09]++{_DIGITS})++(?=[\x20\x09-\x0D\"')\]}}>,;:!?]|\z)"
#: Kinds of candidates.
CANDIDATES = ("token", "run")
#: Characters on each side that hold the words of a context.
CONTEXT = 64


def _order() -> Column:
    """A kind's place among the kinds."""
    return F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))


def _passes(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, r"^0+(?=[0-9])", ""))
    ip = F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(999)) <= 255))
    figures = F.transform(F.split(F.reverse(digits), ""), lambda d: F.coalesce(d.try_cast("int"), F.lit(0)))
    doubled = F.transform(figures, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    luhn = F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0
    card = F.when((n >= 14) & (n <= 19), luhn).otherwise(F.lit(False))
    return F.when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", (n >= 10) & (n <= 15)).otherwise(F.lit(True))


def raw_matches(docs: DataFrame) -> DataFrame:
    """(doc_id, h, kind, i, gap, value, left, right): matches in order, with what lies before each; kinds token and run for candidates."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("h", F.xxhash64("text")).where(F.col("text").rlike("[0-9@]"))
    patterns = KINDS | {"token": TOKEN, "run": RUN}
    for kind, pattern in patterns.items():
        found = F.regexp_extract_all("text", F.lit(pattern), 0)
        docs = docs.withColumn(f"m_{kind}", F.when(F.contains("text", F.lit("@")), found) if kind == "email" else F.when(F.contains("text", F.lit("+")), found) if kind == "phone" else found)
    for kind, pattern in patterns.items():
        docs = docs.withColumn(f"p_{kind}", F.when(F.size(f"m_{kind}") > 0, F.split("text", pattern, -1)))
    one = lambda kind: F.coalesce(F.transform(f"m_{kind}", lambda v, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(F.get(f"p_{kind}", i)).alias("gap"), v.alias("value"), F.right(F.get(f"p_{kind}", i), F.lit(CONTEXT)).alias("left"), F.left(F.get(f"p_{kind}", i + 1), F.lit(CONTEXT)).alias("right"))), F.array().cast("array<struct<kind:string,i:int,gap:int,value:string,left:string,right:string>>"))
    return docs.select("doc_id", "h", F.inline(F.concat(*[one(k) for k in patterns])))


def instances(docs: DataFrame) -> DataFrame:
    """(doc_id, h, kind, start, end, value, before, before2, after): base spans, and tokens (kind null) that overlap none."""
    # Repeated rows have equal matches, which count once here and are given to each row at the end.
    rows = raw_matches(docs).dropDuplicates(["doc_id", "h", "kind", "i"])
    in_order = Window.partitionBy("doc_id", "h", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.repartition("doc_id", "h").withColumn("end", F.sum(F.col("gap") + F.length("value")).over(in_order)).withColumn("start", F.col("end") - F.length("value"))
    rows = rows.where(F.col("kind").isin(*CANDIDATES) | _passes(F.col("kind"), F.col("value")))
    # A candidate is a token without the punctuation around it.
    token = F.col("kind").isin(*CANDIDATES)
    lead = F.length(F.regexp_extract("value", r"^[\"'(\[{<]*", 0))
    trail = F.length(F.regexp_extract("value", r"[\"')\]}>.,;:!?]*+$", 0))
    rows = rows.withColumns({"start": F.when(token, F.col("start") + lead).otherwise(F.col("start")), "end": F.when(token, F.col("end") - trail).otherwise(F.col("end")), "value": F.when(token, F.substring("value", lead + 1, F.length("value") - lead - trail)).otherwise(F.col("value"))})
    by_start = Window.partitionBy("doc_id", "h").orderBy("start", "end")
    base_end, base_start = F.when(~token, F.col("end")), F.when(~token, F.col("start"))
    rows = rows.withColumns({"reached": F.max(base_end).over(by_start.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "next_base": F.min(base_start).over(by_start.rowsBetween(Window.currentRow, Window.unboundedFollowing))})
    free = (F.coalesce("reached", F.lit(-1)) <= F.col("start")) & (F.col("next_base").isNull() | (F.col("next_base") >= F.col("end")))
    rows = rows.where(~token | (free & F.col("value").rlike("[0-9@]")))
    # A token in a run that overlaps no base span is no candidate of its own.
    until = Window.partitionBy("doc_id", "h").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("run_end", F.max(F.when(F.col("kind") == "run", F.col("end"))).over(until))
    rows = rows.where((F.col("kind") != "token") | F.col("run_end").isNull() | (F.col("run_end") <= F.col("start")))
    word = lambda side, pattern: F.nullif(F.lower(F.regexp_extract(side, pattern, 1)), F.lit(""))
    return rows.select(
        "doc_id", "h", F.when(~token, F.col("kind")).alias("kind"), "start", "end", "value", word("left", r"([^\x20\x09-\x0D]+)[\x20\x09-\x0D\"'(\[{<]*+$").alias("before"),
        word("left", r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]+[^\x20\x09-\x0D]+)[\x20\x09-\x0D\"'(\[{<]*+$").alias("before2"), word("right", r"^[^\x20\x09-\x0D]*+[\x20\x09-\x0D]++([^\x20\x09-\x0D]+)").alias("after"),
    )


def bootstrapped(found: DataFrame, rounds: int = 2, least_seeds: int = 3, pattern_score: float = 0.6, confidence: float = 0.8) -> DataFrame:
    """(doc_id, h, kind, start, end) of the tokens that the graph's scores make identifiers.

    A pattern needs ``least_seeds`` different trusted instances of its kind and a score of
    ``pattern_score``; a token needs ``confidence``. Scores use all matches of the table.
    """
    patterns = F.array_compact(F.array(F.concat(F.lit("b "), "before"), F.concat(F.lit("2 "), "before2"), F.concat(F.lit("a "), "after")))
    edges = materialize(found.select(F.lower("value").alias("instance"), "kind", F.explode(patterns).alias("pattern")).distinct(), "pattern-instances")
    links = edges.select("pattern", "instance").distinct()
    totals = links.groupBy("pattern").agg(F.count("*").alias("n"))
    seeds = found.where("kind is not null").select(F.lower("value").alias("instance"), "kind").distinct().withColumn("confidence", F.lit(1.0))
    trusted, learned = seeds, None
    for _ in range(rounds):
        sums = links.join(trusted, "instance").groupBy("pattern", "kind").agg(F.sum("confidence").alias("s"), F.count("*").alias("support"))
        scores = sums.join(totals, "pattern").where(F.col("support") >= least_seeds).select("pattern", "kind", (F.col("s") / (F.col("n") + 1)).alias("score")).where(F.col("score") >= pattern_score)
        by_kind = links.join(scores, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.ln(1 - F.col("score"))))).alias("confidence"))
        learned = materialize(by_kind.join(seeds.select("instance").distinct(), "instance", "left_anti"), "learned-instances")
        trusted = seeds.union(learned.where("confidence >= 0.5"))
    best = learned.groupBy("instance").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"), F.max("confidence").alias("confidence")).where(F.col("confidence") >= confidence)
    tokens = found.where("kind is null").drop("kind").withColumn("instance", F.lower("value"))
    return tokens.join(best, "instance").select("doc_id", "h", "kind", "start", "end")


def all_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, h, kind, start, end, base): every span; h is the text's hash."""
    found = materialize(instances(docs), "pii-instances")
    base = found.where("kind is not null").select("doc_id", "h", "kind", "start", "end", F.lit(True).alias("base"))
    return base.union(bootstrapped(found).withColumn("base", F.lit(False)))


def _printed(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


@beside("doc_id", "text", "n_chars")
def redact(docs: DataFrame) -> DataFrame:
    """The documents, with their columns, where the kind in angle brackets stands for each span; overlapping spans are one, of the first's kind."""
    spans = all_spans(docs).withColumn("order", _order())
    by_start = Window.partitionBy("doc_id", "h").orderBy("start", "order", "end")
    reached = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.when(reached.isNull() | (F.col("start") >= reached), 1).otherwise(0))
    spans = spans.withColumn("part", F.sum("new").over(by_start.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = spans.groupBy("doc_id", "h", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "order")).alias("kind"))
    of_doc = merged.groupBy("doc_id", "h").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("spans")).withColumnsRenamed({"doc_id": "_id", "h": "_h"})
    rows = docs.join(of_doc, docs["doc_id"].cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("_h")), "left")
    begin = lambda i: F.coalesce(F.get("spans", i - 1)["end"], F.lit(0))
    pieces = F.transform("spans", lambda s, i: F.concat(F.substring("text", (begin(i) + 1).cast("int"), (s["start"] - begin(i)).cast("int")), F.lit("<"), F.upper(s["kind"]), F.lit(">")))
    text = F.concat(F.array_join(pieces, ""), F.substring("text", (F.element_at("spans", -1)["end"] + 1).cast("int"), F.length("text")))
    rows = rows.withColumn("text", F.when(F.col("spans").isNull(), F.col("text")).otherwise(text))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("spans").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    spans = all_spans(docs).withColumn("order", _order())
    item = F.struct("start", "order", "end", "kind")
    count = lambda kind: F.count_if(F.col("base") & (F.col("kind") == kind)).alias(f"n_{kind}")
    of_doc = spans.groupBy("doc_id", "h").agg(*[count(k) for k in KINDS], F.array_sort(F.collect_list(F.when(F.col("base"), item))).alias("own"), F.array_sort(F.collect_list(item)).alias("every"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    of_doc = of_doc.withColumnsRenamed({"doc_id": "_id", "h": "_h"})
    rows = rows.join(of_doc, rows["doc_id"].eqNullSafe(of_doc["_id"]) & (rows["h"] == of_doc["_h"]), "left")
    none = F.array().cast("array<struct<start:bigint,order:bigint,end:bigint,kind:string>>")
    return rows.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(_printed(F.coalesce("own", none)).cast("binary"), 256).alias("base_sha256"), _printed(F.coalesce("every", none)).alias("spans"))
