"""Scoring of extracted records against true ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import dates, identifiers, numbers, text
from paperloom.functions.blanks import is_blank
from paperloom.session import durable

# Kinds of comparison by the names that fields declare.
KINDS = {
    "exact": "exact strict id", "text": "string text fuzzy name", "numeric": "numeric number int float money amount currency percentage rub",
    "inn": "inn snils ogrn ogrnip", "date": "date datetime",
}
_KIND = {name: kind for kind, names in KINDS.items() for name in names.split()}
#: Least score at which a record passes.
PASS = 70.0


def kind_of(declared: str | None) -> str:
    return _KIND.get((declared or "").strip().lower(), "text")


def field_score(pred: Column, truth: Column, declared: str | None = None) -> tuple[Column, Column]:
    """(score, state) of one field. Absent on both sides has no score; only one side filled has 0."""
    kind = kind_of(declared)
    p, t = pred.cast("string"), truth.cast("string")
    state = F.when(is_blank(t) & is_blank(p), "absent_both").when(is_blank(t), "hallucination").when(is_blank(p), "missed").otherwise("scored")
    if kind == "numeric":
        both = F.struct(numbers.loose_number(p).alias("x"), numbers.loose_number(t).alias("y"))
        score = numbers.let(both, lambda v: F.when(v["x"].isNull() | v["y"].isNull(), 0.0).otherwise(numbers.proximity(v["x"], v["y"])))
    elif kind == "inn":
        same = (identifiers.digits(p) == identifiers.digits(t)) & (identifiers.digits(p) != "")
        score = F.when(~same, 0.0).when(identifiers.valid_inn(p), 100.0).otherwise(50.0)
    elif kind == "date":
        score = F.when(dates.flexible_date(p) == dates.flexible_date(t), 100.0).otherwise(0.0)
    elif kind == "exact":
        score = text.exact_score(p, t)
    else:
        score = text.similarity_score(p, t)
    return F.when(state == "scored", score).when(state != "absent_both", 0.0), state


def record_scores(joined: DataFrame, key: list[str], fields: dict[str, tuple[Column, Column, str, float]]) -> DataFrame:
    """One row for each record: overall score, what was missed and what made up, and whether it passes.

    ``fields`` has {label: (extracted, true, kind, weight)}. The denominator are the weights of fields that the true
    record has; made-up fields are a penalty.
    """
    cells = []
    for label, (pred, truth, declared, weight) in fields.items():
        score, state = field_score(pred, truth, declared)
        cells.append(F.struct(F.lit(label).alias("label"), score.alias("score"), state.alias("state"), F.lit(float(weight)).alias("weight")))
    held = joined.select(*key, F.array(*cells).alias("_f"))

    def total(states: list[str], value) -> Column:
        return F.aggregate(F.filter("_f", lambda x: x["state"].isin(*states)), F.lit(0.0), lambda a, x: a + value(x))

    def labels(state: str) -> Column:
        return F.transform(F.filter("_f", lambda x: x["state"] == state), lambda x: x["label"])

    due = total(["scored", "missed"], lambda x: x["weight"])
    net = total(["scored"], lambda x: x["score"] * x["weight"] / 100) - total(["hallucination"], lambda x: x["weight"])
    out = held.select(*key, due.alias("truth_weight"), net.alias("_net"), labels("missed").alias("missed"), labels("hallucination").alias("made_up"))
    overall = F.bround(F.when(F.col("truth_weight") > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("_net") / F.col("truth_weight") * 100))).otherwise(0.0), 2)
    out = out.withColumn("overall", overall).drop("_net")
    return out.withColumn("status", text.score_status(F.col("overall"))).withColumn("passed", (F.col("overall") >= PASS) & (F.size("made_up") == 0))


def with_truth(pred: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """``pred`` left-joined with ``truth`` (columns prefixed ``t_``) and the mode of comparison; of equal keys the last holds.

    ``truth`` must have ``_seq``, its order.
    """
    last = truth.groupBy(key).agg(*[F.max_by(c, "_seq").alias(f"t_{c}") for c in truth.columns if c not in (key, "_seq")], F.lit(True).alias("_known"))
    joined = pred.join(last, key, "left")
    return joined.withColumn("mode", F.when(F.col("_known"), "benchmark").otherwise("autonomous_no_ground_truth_match")).drop("_known")


def completeness(df: DataFrame, rules: dict[str, Column]) -> Column:
    """Share of the rules that hold, 0 to 100; a null rule doesn't hold."""
    held = sum((F.coalesce(r, F.lit(False)).cast("int") for r in rules.values()), F.lit(0))
    return F.bround(held * 100.0 / max(len(rules), 1), 1)


def suite(truth: DataFrame, results: DataFrame, fields: dict[str, tuple[str, str, float]], name: str = "file_name", saved: str = "saved_as") -> DataFrame:
    """Scores of every true record with the result found for it, and ``extracted``: whether there was one.

    Results are found by the stem of the true file's name, as ``stem_Full``, ``stem`` or ``stem_type`` in this order, and
    of equal names the one whose path is first. A record without a result is compared with itself; that measures the
    truth's own schema only, so it must not be averaged with the others. ``fields`` are {label: (path, kind, weight)};
    both frames have doc_type. Repeated true records keep their rows.
    """
    paths = {label: path for label, (path, _, _) in fields.items()}
    stems = truth.select(F.monotonically_increasing_id().alias("_id"), name, "doc_type", F.regexp_replace(name, r"\.[^.]*$", "").alias("_stem"), *[F.col(p).alias(f"t_{n}") for n, p in paths.items()])
    stems = durable(stems)
    ways = F.array(*[F.struct(F.lit(i).alias("rank"), c.alias("key")) for i, c in enumerate((F.concat("_stem", F.lit("_Full")), F.col("_stem"), F.concat_ws("_", "_stem", "doc_type")))])
    found = results.select(F.col(saved).alias("key"), F.struct(F.col("path"), *[F.col(p).cast("string").alias(n) for n, p in paths.items()]).alias("_r")).groupBy("key").agg(F.min("_r").alias("_r"))
    best = stems.select("_id", F.inline(ways)).join(found, "key").groupBy("_id").agg(F.min(F.struct("rank", "_r"))["_r"].alias("_r"))
    joined = stems.join(best, "_id", "left").withColumn("extracted", F.col("_r").isNotNull())
    pred = {n: F.when(F.col("extracted"), F.col(f"_r.{n}")).otherwise(F.col(f"t_{n}").cast("string")) for n in paths}
    scored = record_scores(joined, ["_id", name, "doc_type", "extracted"], {n: (pred[n], F.col(f"t_{n}"), kind, weight) for n, (_, kind, weight) in fields.items()})
    return scored.drop("_id")


def suite_averages(scored: DataFrame) -> DataFrame:
    """For each type and for all (null): records, how many were extracted, their accuracy, and the truth's own integrity; 0 where there are none."""
    of = lambda there: F.coalesce(F.bround(F.avg(F.when(F.col("extracted") == there, F.col("overall"))), 2), F.lit(0.0))
    return scored.rollup("doc_type").agg(F.count(F.lit(1)).alias("records"), F.sum(F.col("extracted").cast("bigint")).alias("extracted"), of(True).alias("accuracy"), of(False).alias("schema_integrity"))
