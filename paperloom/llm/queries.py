"""Queries of the text-preparation problems and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm import address_links, canon_list, glyphs, langid, lexicon, mixing, name_links, packing, tokens
from paperloom.session import durable, table

GLYPH_FIELDS = {
    "executive_documents": {"executive_documents.case_number": ("case_number", "number")},
    "enforcement_orders": {
        "enforcement_orders.reg_number": ("reg_number", "number"),
        "enforcement_orders.court.blank_number": ("court.blank_number", "number"),
        "enforcement_orders.claimant.name": ("claimant.name", "name"),
    },
}


LISTED = {
    "executive_documents.court.court_type": ("executive_documents", "court.court_type"),
    "commercial_contracts.contract_type": ("commercial_contracts", "contract_type"),
    "enforcement_orders.court.doc_type": ("enforcement_orders", "court.doc_type"),
    "enforcement_orders.claimant.party_type": ("enforcement_orders", "claimant.party_type"),
}


def p1_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each value of the four fields with the entry meant (0: none) and its distance."""
    values = canon_list.field_values({p: (table(spark, sf_dir, t), c) for p, (t, c) in LISTED.items()}, "rec_id")
    return canon_list.map_to_list(values, table(spark, sf_dir, "ref_values"), lexicon.ALIASES)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that aren't entries letter for letter, with the entry meant or 0."""
    entries = table(spark, sf_dir, "ref_values").select("field_path", F.col("canonical").alias("value"))
    odd = p1_mapped(spark, sf_dir).where(F.col("value").rlike("(?U)\\S"))
    return odd.join(entries, ["field_path", "value"], "left_anti").select("field_path", "rec_id", "ref_id")


def p1_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that no entry stands for, with how often they occur."""
    return p1_mapped(spark, sf_dir).where(F.col("ref_id") == canon_list.MISS).groupBy("field_path", "value").agg(F.count(F.lit(1)).alias("n"))


def p2_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each value of the four fields with the one form a reader sees."""
    parts = [glyphs.unify_fields(table(spark, sf_dir, t), "rec_id", fields) for t, fields in GLYPH_FIELDS.items()]
    return parts[0].unionByName(parts[1])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that aren't stored in that form."""
    return p2_unified(spark, sf_dir).where(F.col("unified") != F.col("value")).select("field_path", "rec_id")


def p3_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each spelling of the four fields with the entity it names."""
    orders, papers = table(spark, sf_dir, "enforcement_orders"), table(spark, sf_dir, "executive_documents")
    named = papers.where(~F.coalesce("is_anonymized", F.lit(False)))
    fields = {
        "enforcement_orders.claimant.name": (orders, "claimant.name", "pot"),
        "enforcement_orders.fssp.officer": (orders, "fssp.officer", "p"),
        "executive_documents.debtor.name": (named, "debtor.name", "po"),
        "executive_documents.court.name": (papers, "court.name", "c"),
    }
    return name_links.entities(name_links.spellings(fields))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of spellings of one person, organisation, authority or court."""
    return name_links.pairs_of(p3_linked(spark, sf_dir))


def _matched_addresses(spark: SparkSession, sf_dir: str) -> address_links.Matched:
    fields = {"enforcement_orders": "fssp.address", "executive_documents": "court.address", "invoices_upd": "seller.address", "salary_deductions": "authority.address"}
    return address_links.matched(address_links.addresses((table(spark, sf_dir, t), c) for t, c in fields.items()))


def p5_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each address of the four fields with its building, how many it might be, and how sure that is."""
    return _matched_addresses(spark, sf_dir).linked


def p5_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The buildings that ambiguous addresses may be, by candidate set."""
    return address_links.candidates_of(_matched_addresses(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of addresses that denote one building."""
    return address_links.pairs_of(p5_linked(spark, sf_dir))


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in a container of each capacity, and (pack_id 0) in containers of all capacities together."""
    sizes = {r["pack_id"]: [r["capacity_tokens"]] for r in table(spark, sf_dir, "pack_sizes").collect()}
    plans = {packing.JOINT: sorted(c for cs in sizes.values() for c in cs), **sizes}
    return packing.packed(tokens.token_counts(table(spark, sf_dir, "documents"), ["doc_id"]), plans)


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p6_packed(spark, sf_dir))


def _source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), ["doc_id", "source"])


def p7_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of each mixture."""
    return mixing.mixed(_source_counts(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p7_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each mixture: records over their cap on repeats, tokens of unlisted sources, and sources far from their share.

    Far is 0.02 and more from the share among the sources that have tokens.
    """
    counts, targets = _source_counts(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    out = durable(mixing.mixed(counts, targets))
    report = mixing.shares(out, targets)
    there = Window.partitionBy("mix_id")
    wanted = F.when(F.col("tokens") > 0, F.col("target_share") / F.sum(F.when(F.col("tokens") > 0, F.col("target_share"))).over(there)).otherwise(0.0)
    far = report.withColumn("_off", F.abs(F.col("actual_share") - wanted) >= 0.02)
    sums = far.groupBy("mix_id").agg(F.count(F.lit(1)).alias("sources"), F.sum((F.col("most_repeats") > F.col("max_repeats")).cast("bigint")).alias("over_cap"), F.sum(F.col("_off").cast("bigint")).alias("far_off"))
    stray = out.join(targets, ["mix_id", "source"], "left_anti").groupBy("mix_id").agg(F.count(F.lit(1)).alias("stray"))
    return sums.join(stray, "mix_id", "left").na.fill(0, ["stray"])


def p6_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each plan: documents, those whose parts don't make up the text, containers over capacity or of one not permitted, texts split without need."""
    docs = tokens.token_counts(table(spark, sf_dir, "documents"), ["doc_id"])
    sizes = {r["pack_id"]: [r["capacity_tokens"]] for r in table(spark, sf_dir, "pack_sizes").collect()}
    out = durable(packing.packed(docs, sizes))
    top = F.create_map(*[F.lit(x) for p, c in sizes.items() for x in (p, max(c))])[F.col("pack_id")]
    whole = out.groupBy("pack_id", "doc_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("parts")).join(docs, "doc_id")
    by_doc = whole.groupBy("pack_id").agg(F.count(F.lit(1)).alias("documents"), F.sum((F.col("tokens") != F.col("n_tokens")).cast("bigint")).alias("incomplete"), F.sum(((F.col("parts") > 1) & (F.col("n_tokens") <= top)).cast("bigint")).alias("split"))
    bins = out.where("container_id IS NOT NULL").groupBy("pack_id", "container_id").agg(F.sum("tokens").alias("used"), F.max("capacity_tokens").alias("capacity"))
    by_bin = bins.groupBy("pack_id").agg(F.sum(((F.col("used") > F.col("capacity")) | (F.col("capacity") != top)).cast("bigint")).alias("over"))
    return by_doc.join(by_bin, "pack_id")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that each mixture reaches."""
    counts, targets = _source_counts(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    return mixing.shares(mixing.mixed(counts, targets), targets, counts)


def p8_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the language found, its confidence, the label's language and the lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    label = F.split(F.trim(F.lower(F.regexp_replace("lang", r"^\s+", ""))), r"[-_\s(]")[0]
    named = F.coalesce(*[F.when(label.isin([n for n, c in langid.CODES.items() if c == code]), code) for code in langid.LANGS])
    found = langid.labelled(docs, langid.fit(docs))
    return found.select("doc_id", F.col("lang").alias("label"), named.alias("label_lang"), "found.lang", "found.confidence", "found.lines")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose label is missing or wrong (line -1) and lines in another language than their document's."""
    found = p8_labelled(spark, sf_dir).where(F.col("lang").isNotNull())
    wrong = F.when(F.col("label_lang").isNull() | (F.col("label_lang") != F.col("lang")), F.array(F.struct(F.lit(-1).cast("bigint").alias("line_no"), F.col("lang")))).otherwise(F.array().cast("array<struct<line_no:bigint,lang:string>>"))
    other = F.transform(F.filter("lines", lambda x: x["lang"] != F.col("lang")), lambda x: F.struct(x["line_no"].alias("line_no"), x["lang"].alias("lang")))
    return found.select("doc_id", F.inline(F.concat(wrong, other)))


QUERIES = {f.__name__: f for f in (p1_found, p1_mapped, p1_misses, p2_found, p2_unified, p3_found, p3_linked, p5_found, p5_linked, p5_candidates, p6_packed, p6_fill, p6_checked, p7_mixed, p7_shares, p7_checked, p8_found, p8_labelled)}
# The statement's plain characters, rule by rule: marks, digits, Cyrillic letters but inside a run of digits; in names also
# Latin letters, but not beside Cyrillic ones. SQL's patterns have no look-around, so the rules stand side by side.
_MARKS = r'\-0-9 №«»“”".,/()\[\]*'
_CYRILLIC, _LATIN = "а-яёА-ЯЁ", "A-Za-zÀ-ÖØ-öø-ɏḀ-ỿ"
_ODD_NUMBER = f"(NOT regexp_full_match(v, '[{_MARKS}{_CYRILLIC}]*') OR regexp_matches(v, '[0-9][{_CYRILLIC}]+[0-9]'))"
_ODD_NAME = f"(NOT regexp_full_match(v, '[{_MARKS}{_CYRILLIC}{_LATIN}]*') OR regexp_matches(v, '[{_CYRILLIC}][{_LATIN}]|[{_LATIN}][{_CYRILLIC}]'))"
ORACLES: dict[str, str] = {
    "p2_found": " UNION ALL ".join(f"SELECT '{p}' AS field_path, rec_id FROM (SELECT rec_id, {c} AS v FROM {t}) WHERE v IS NOT NULL AND {_ODD_NAME if policy == 'name' else _ODD_NUMBER}" for t, fields in GLYPH_FIELDS.items() for p, (c, policy) in fields.items()),
    "p6_checked": "SELECT pack_id, (SELECT count(*) FROM documents) AS documents, 0::BIGINT AS incomplete, 0::BIGINT AS split, 0::BIGINT AS over FROM pack_sizes",
    "p7_checked": "SELECT mix_id, count(*) AS sources, 0::BIGINT AS over_cap, 0::BIGINT AS far_off, 0::BIGINT AS stray FROM mix_targets GROUP BY mix_id",
}
