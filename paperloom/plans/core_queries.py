"""Queries of the core operators over the data's tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import blanks, dates, evidence, identifiers, numbers, paths, text
from paperloom.operators import audit, flat, guardrails, measure, recovery, registry, rollup, routing, scoring
from paperloom.session import table
from paperloom.sources import files, replies

RECORDS = ("enforcement_orders", "executive_documents", "salary_deductions", "invoices_upd", "commercial_contracts", "legal_claims")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# -- SQL of the scalar functions, for the checks only


def _sum(d: str, weights: list[int]) -> str:
    return " + ".join(f"TRY_CAST(substr({d}, {i + 1}, 1) AS INT) * {w}" for i, w in enumerate(weights))


def _inn(x: str) -> str:
    d = f"regexp_replace({x}, '\\D', '', 'g')"
    at = lambda i: f"TRY_CAST(substr({d}, {i}, 1) AS INT)"
    ten = f"({_sum(d, identifiers.INN10)}) % 11 % 10 = {at(10)}"
    twelve = f"({_sum(d, identifiers.INN12A)}) % 11 % 10 = {at(11)} AND ({_sum(d, identifiers.INN12B)}) % 11 % 10 = {at(12)}"
    return f"coalesce(CASE WHEN length({d}) = 10 THEN {ten} WHEN length({d}) = 12 THEN {twelve} END, false)"


def _ogrn(x: str) -> str:
    d = f"regexp_replace({x}, '\\D', '', 'g')"
    rest = lambda n, by: f"TRY_CAST(substr({d}, 1, {n}) AS BIGINT) % {by} % 10 = TRY_CAST(substr({d}, {n + 1}, 1) AS INT)"
    return f"coalesce(CASE WHEN length({d}) = 13 THEN {rest(12, 11)} WHEN length({d}) = 15 THEN {rest(14, 13)} END, false)"


def _kpp(x: str) -> str:
    return f"coalesce(length(regexp_replace({x}, '\\D', '', 'g')) = 9, false)"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^[\\s\\p{{Z}}\\x0b\\x{{85}}]+|[\\s\\p{{Z}}\\x0b\\x{{85}}]+$', '', 'g')"


def _blank(x: str) -> str:
    return f"({x} IS NULL OR lower({_trim(x)}) IN ('', 'none', 'null', 'nan'))"


def _loose(x: str) -> str:
    s = f"regexp_replace({x}, '[^0-9,.\\-]', '', 'g')"
    return f"""TRY_CAST(CASE WHEN contains({s}, ',') AND contains({s}, '.') THEN
        CASE WHEN regexp_matches({s}, ',[^.]*$') THEN replace(replace({s}, '.', ''), ',', '.') ELSE replace({s}, ',', '') END
        WHEN contains({s}, ',') THEN CASE WHEN regexp_matches({s}, ',[^,]{{1,2}}$') THEN replace({s}, ',', '.') ELSE replace({s}, ',', '') END
        ELSE {s} END AS DOUBLE)"""


def _date(x: str) -> str:
    s = f"lower({_trim(x)})"
    built = lambda p, y, m, d: f"TRY_CAST(nullif(concat_ws('-', nullif(regexp_extract({s}, '{p}', {y}), ''), lpad(regexp_extract({s}, '{p}', {m}), 2, '0'), lpad(regexp_extract({s}, '{p}', {d}), 2, '0')), '-00-00') AS DATE)"
    iso, dots, slashes = r"\b(\d{4})-(\d{2})-(\d{2})\b", r"\b(\d{1,2})\.(\d{1,2})\.(\d{4})\b", r"(?:^|[^\w/])(\d{1,2})/(\d{1,2})/(\d{4})(?:[^\d/]|$)"
    names = "|".join(n for ns in dates.MONTHS.values() for n in ns.split()[::-1])
    words = rf"(\d{{1,2}})\s+({names})\s+(\d{{4}})"
    month = "CASE " + " ".join(f"WHEN regexp_extract({s}, '{words}', 2) IN ('{ns.split()[0]}', '{ns.split()[1]}') THEN '{m:02d}'" for m, ns in dates.MONTHS.items()) + " END"
    worded = f"TRY_CAST(regexp_extract({s}, '{words}', 3) || '-' || {month} || '-' || lpad(regexp_extract({s}, '{words}', 1), 2, '0') AS DATE)"
    return f"coalesce({built(iso, 1, 2, 3)}, {built(dots, 3, 2, 1)}, {built(slashes, 3, 2, 1)}, {worded})"


def _comparable(x: str) -> str:
    return f"coalesce(translate(replace(regexp_replace({_trim(f'lower({x})')}, '[\\s\\p{{Z}}\\x0b\\x{{85}}]+', ' ', 'g'), '№', 'no'), '{text.FOLD_FROM}', '{text.FOLD_TO}'), '')"


# -- identifiers, numbers, dates


@query(f"SELECT rec_id, {_inn('seller.inn')} AS seller_inn_ok, {_inn('buyer.inn')} AS buyer_inn_ok, {_kpp('seller.kpp')} AS seller_kpp_ok FROM invoices_upd")
def q_invoice_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "invoices_upd")
    return df.select("rec_id", identifiers.valid_inn(F.col("seller.inn")).alias("seller_inn_ok"), identifiers.valid_inn(F.col("buyer.inn")).alias("buyer_inn_ok"), identifiers.valid_kpp(F.col("seller.kpp")).alias("seller_kpp_ok"))


@query(f"SELECT rec_id, {_inn('party_one.inn')} AS inn_ok, {_ogrn('party_one.ogrn')} AS ogrn_ok FROM commercial_contracts")
def q_contract_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "commercial_contracts")
    return df.select("rec_id", identifiers.valid_inn(F.col("party_one.inn")).alias("inn_ok"), identifiers.valid_ogrn(F.col("party_one.ogrn")).alias("ogrn_ok"))


@query(f"SELECT rec_id, {_loose('finances.fee_penalty')} AS fee, {_loose('legal_base')} AS base FROM enforcement_orders")
def q_loose_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "enforcement_orders")
    return df.select("rec_id", numbers.loose_number(F.col("finances.fee_penalty")).alias("fee"), numbers.loose_number(F.col("legal_base")).alias("base"))


_P = "lower(finances.deduction_percentage)"


@query(rf"""SELECT rec_id, CASE WHEN regexp_matches({_P}, '(\d+(?:[.,]\d+)?)\s*%') THEN TRY_CAST(replace(regexp_extract({_P}, '(\d+(?:[.,]\d+)?)\s*%', 1), ',', '.') AS DOUBLE)
    WHEN regexp_matches({_P}, '(\d+)\s*процент') THEN TRY_CAST(regexp_extract({_P}, '(\d+)\s*процент', 1) AS DOUBLE)
    WHEN regexp_matches({_P}, '\b\d{{1,2}}\s*/\s*\d{{1,2}}(?:\D|$)') THEN
        round(TRY_CAST(regexp_extract({_P}, '(\d+)\s*/\s*(\d+)', 1) AS INT) * 100.0 / TRY_CAST(regexp_extract({_P}, '(\d+)\s*/\s*(\d+)', 2) AS INT), 2) END AS percentage FROM salary_deductions""")
def q_percentages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "salary_deductions").select("rec_id", numbers.percentage(F.col("finances.deduction_percentage")).alias("percentage"))


_DATED = {t: "act_date" if t == "executive_documents" else "doc_date" for t in RECORDS}


@query(" UNION ALL ".join(f"SELECT '{t}' AS source_table, rec_id, {_date(c)} AS parsed FROM {t}" for t, c in _DATED.items()))
def q_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, t).select(F.lit(t).alias("source_table"), "rec_id", dates.flexible_date(F.col(c)).alias("parsed")) for t, c in _DATED.items()]
    return reduce(DataFrame.unionByName, parts)


_S = _trim("doc_date")


@query(rf"""SELECT rec_id, CASE WHEN coalesce({_S}, '') = '' THEN ''
    WHEN regexp_matches({_S}, '(\d{{1,2}})[./\-](\d{{1,2}})[./\-](\d{{4}})') THEN concat_ws('-', regexp_extract({_S}, '(\d{{1,2}})[./\-](\d{{1,2}})[./\-](\d{{4}})', 3), lpad(regexp_extract({_S}, '(\d{{1,2}})[./\-](\d{{1,2}})[./\-](\d{{4}})', 2), 2, '0'), lpad(regexp_extract({_S}, '(\d{{1,2}})[./\-](\d{{1,2}})[./\-](\d{{4}})', 1), 2, '0'))
    WHEN regexp_matches({_S}, '(\d{{4}})[./\-](\d{{1,2}})[./\-](\d{{1,2}})') THEN concat_ws('-', regexp_extract({_S}, '(\d{{4}})[./\-](\d{{1,2}})[./\-](\d{{1,2}})', 1), lpad(regexp_extract({_S}, '(\d{{4}})[./\-](\d{{1,2}})[./\-](\d{{1,2}})', 2), 2, '0'), lpad(regexp_extract({_S}, '(\d{{4}})[./\-](\d{{1,2}})[./\-](\d{{1,2}})', 3), 2, '0'))
    ELSE {_S} END AS iso FROM legal_claims""")
def q_iso_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "legal_claims").select("rec_id", dates.iso_text(F.col("doc_date")).alias("iso"))


@query(f"""SELECT rec_id, CASE WHEN b IS NULL OR a IS NULL THEN 'incomplete' WHEN a < b THEN 'inverted' ELSE 'ok' END AS chronology
    FROM (SELECT rec_id, {_date('contract_basis_date')} AS b, {_date('doc_date')} AS a FROM legal_claims)""")
def q_chronology(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "legal_claims")
    return df.select("rec_id", dates.in_order(dates.flexible_date(F.col("contract_basis_date")), dates.flexible_date(F.col("doc_date"))).alias("chronology"))


# -- audit


def _audit_sql(name: str) -> str:
    spec = audit.SPECS[name]
    kinds = {"inn": _inn, "ogrn": _ogrn, "kpp": _kpp}
    checked, correct, wrong, codes = [], [], [], []
    for r in spec.identifiers:
        x = r["path"]
        full = f"(NOT {_blank(x)} AND NOT length(regexp_replace({x}, '\\D', '', 'g')) < 9)"
        ok = kinds[r["kind"]](x)
        checked.append(f"CAST({full} AS INT)")
        correct.append(f"CAST({full} AND {ok} AS INT)")
        if r.get("severity", "error") == "error":
            wrong.append(f"({full} AND NOT {ok})")
            codes.append(f"CASE WHEN {wrong[-1]} THEN '{r['kind'].upper()}_CHECKSUM' END")
    money = []
    for r in spec.money:
        total, parts = r["total"], r["parts"]
        filled = " + ".join(f"CAST({p} IS NOT NULL AS INT)" for p in parts)
        applies = f"({total} IS NOT NULL AND ({filled}) >= {r.get('min_parts', 2)})"
        off = f"abs(round({' + '.join(f'coalesce({p}, 0.0::DOUBLE)' for p in parts)}, 2) - {total}) > 0.05"
        money.append(applies)
        wrong.append(f"coalesce({applies} AND {off}, false)")
        codes.append(f"CASE WHEN {wrong[-1]} THEN '{r['code']}' END")
    checks, ok, error, some = " + ".join(checked) or "0", " + ".join(correct) or "0", " OR ".join(wrong) or "false", " OR ".join(money) or "false"
    return f"""SELECT rec_id, CAST({checks} AS INT) AS checksums_checked, CAST({ok} AS INT) AS checksums_ok,
        CASE WHEN {error} THEN 'discrepancy' WHEN ({ok}) > 0 AND ({some}) THEN 'verified' WHEN ({checks}) > 0 OR ({some}) THEN 'partially_verified' ELSE 'unverified' END AS verdict,
        array_to_string(list_sort(list_distinct(list_filter([{', '.join(codes)}], lambda x: x IS NOT NULL))), '; ') AS error_codes FROM {name}"""


def _audit(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = audit.audited(table(spark, sf_dir, name), audit.SPECS[name])
        return out.select("rec_id", "checksums_checked", "checksums_ok", "verdict", audit.codes_of().alias("error_codes"))

    return run


for _name in RECORDS:
    QUERIES[f"q_audit_{_name}"] = _audit(_name)
    ORACLES[f"q_audit_{_name}"] = _audit_sql(_name)


@query("SELECT doc_type, count(*) FILTER (verdict = 'verified') AS verified, count(*) FILTER (verdict = 'partially_verified') AS partially_verified, count(*) FILTER (verdict = 'discrepancy') AS discrepancy, count(*) FILTER (verdict = 'unverified') AS unverified FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS doc_type, verdict FROM ({_audit_sql(t)})" for t in RECORDS) + ") GROUP BY doc_type")
def q_verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [audit.audited(table(spark, sf_dir, t), audit.SPECS[t]).select(F.lit(t).alias("doc_type"), "verdict") for t in RECORDS]
    return rollup.status_counts(reduce(DataFrame.unionByName, parts), "verdict", ["verified", "partially_verified", "discrepancy", "unverified"])


# -- registries

_IDENTITY = "coalesce(file_path, '') || '||' || coalesce(file_name, '') || '||' || coalesce(doc_type, '')"
_BY_TIME = "processed_at DESC NULLS LAST, received_at DESC NULLS LAST, rec_id DESC"


def _when() -> list:
    return [F.col("processed_at"), F.col("received_at"), F.col("rec_id")]


@query(f"SELECT rec_id, file_path, doc_type FROM enforcement_orders QUALIFY row_number() OVER (PARTITION BY {_IDENTITY} ORDER BY {_BY_TIME}) = 1")
def q_registry_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "enforcement_orders")
    return registry.latest(df, registry.identity(), _when(), ["rec_id", "file_path", "doc_type"])


_CUT = "TIMESTAMP '2023-01-01 00:00:00'"


@query(f"SELECT rec_id, file_path, file_name, doc_type FROM executive_documents QUALIFY row_number() OVER (PARTITION BY {_IDENTITY} ORDER BY CAST(coalesce(received_at >= {_CUT}, false) AS INT) DESC, rec_id DESC) = 1")
def q_registry_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "executive_documents").select("rec_id", "file_path", "file_name", "doc_type", "received_at")
    new = F.coalesce(F.col("received_at") >= F.expr(_CUT), F.lit(False))
    return registry.merged(df.where(~new), df.where(new), ["file_path", "file_name", "doc_type"], "rec_id").select("rec_id", "file_path", "file_name", "doc_type")


@query("SELECT rec_id, doc_number FROM legal_claims l WHERE NOT EXISTS (SELECT 1 FROM raw_payloads p WHERE p.doc_type = 'legal_claims' AND p.rec_id = l.rec_id)")
def q_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "raw_payloads").where("doc_type = 'legal_claims'")
    return registry.remaining(table(spark, sf_dir, "legal_claims").select("rec_id", "doc_number"), done, "rec_id")


@query("""WITH f AS (SELECT rec_id, file_path, regexp_replace(file_name, '\\.[^.]*$', '') AS stem FROM invoices_upd),
    o AS (SELECT stem, file_path, row_number() OVER (PARTITION BY stem ORDER BY file_path) AS n FROM (SELECT DISTINCT stem, file_path FROM f))
    SELECT rec_id, CASE WHEN n = 1 THEN f.stem ELSE f.stem || '__' || n END AS save_as FROM f JOIN o USING (stem, file_path)""")
def q_numbered_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "invoices_upd").select("rec_id", "file_path", F.regexp_replace("file_name", r"\.[^.]*$", "").alias("stem"))
    return registry.numbered_names(df, "stem", "file_path").select("rec_id", "save_as")


@query("SELECT doc_id, sha256(coalesce(doc_type, '') || '::' || coalesce(case_number, '') || '::' || coalesce(file_name, '')) AS key FROM documents")
def q_cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", registry.cache_key(F.col("doc_type"), F.col("case_number"), F.col("file_name")).alias("key"))


@query("SELECT event_id, user_id FROM events ORDER BY ts DESC NULLS LAST, event_id DESC LIMIT 5000")
def q_bounded_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 5,000 calls, the feature's own bound."""
    return registry.newest(table(spark, sf_dir, "events"), 5000, "ts", "event_id").select("event_id", "user_id")


@query(" UNION ".join(f"SELECT doc_type FROM {t} WHERE doc_type IS NOT NULL" for t in (*RECORDS, "raw_payloads", "documents")))
def q_known_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, t).select("doc_type").where("doc_type IS NOT NULL").distinct() for t in (*RECORDS, "raw_payloads", "documents")]
    return reduce(DataFrame.unionByName, parts).distinct()


# -- routing


def _route_sql(path: str, content: str) -> str:
    ordered = sorted(routing.ROUTES, key=lambda r: -r.priority)
    escape = lambda w: w.replace(".", "\\.")
    glob = lambda g: ".*".join(escape(p) for p in g.split("*") if p)
    ways = [(f"regexp_matches({path}, '{'|'.join(map(glob, r.path_patterns))}')", r, 0.95, "heuristic_path") for r in ordered if r.path_patterns]
    ways += [(f"regexp_matches({path}, '{'|'.join(f'(^|[^а-яёa-z0-9]){escape(w)}([^а-яёa-z0-9]|$)' for w in r.keywords)}')", r, 0.90, "heuristic_keyword") for r in ordered if r.keywords]
    ways += [(" OR ".join(f"contains({content}, '{m}')" for m in r.markers), r, 0.92, "text_content_marker") for r in ordered]
    case = lambda pick, other: "CASE " + " ".join(f"WHEN {c} THEN {pick(r, conf, how)}" for c, r, conf, how in ways) + f" ELSE {other} END"
    return f"{case(lambda r, c, h: repr(r.doc_type), repr('unknown'))} AS found_type, CAST({case(lambda r, c, h: c, 0.0)} AS DOUBLE) AS confidence, {case(lambda r, c, h: repr(h), repr('unknown'))} AS method"


@query(f"SELECT doc_id, {_route_sql('lower(file_name)', 'lower(text)')} FROM documents")
def q_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").select("doc_id", routing.routed(F.col("file_name"), F.col("text")).alias("r"))
    return df.select("doc_id", F.col("r.doc_type").alias("found_type"), "r.confidence", "r.method")


@query(f"""SELECT doc_type, count(*) AS files, count(*) FILTER (doc_type = found_type) AS "right", count(*) FILTER (doc_type <> found_type AND found_type <> 'unknown') AS wrong, count(*) FILTER (found_type = 'unknown') AS unrouted
    FROM (SELECT doc_type, {_route_sql('lower(file_name)', 'lower(text)')} FROM documents) GROUP BY ROLLUP (doc_type)""")
def q_routing_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").select("doc_type", routing.routed(F.col("file_name"), F.col("text"))["doc_type"].alias("found_type"))
    return routing.accuracy(df, "doc_type", "found_type")


@query("SELECT lower(regexp_extract(file_name, '\\.([^./\\\\]+)$', 1)) AS ext, count(*) AS files FROM enforcement_orders GROUP BY 1")
def q_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "enforcement_orders").groupBy(files.extension(F.col("file_name")).alias("ext")).agg(F.count(F.lit(1)).alias("files"))


# -- scoring

_PRED = {"doc_number": "doc_number", "doc_date": "doc_date", "total": "finances.total_rub|finances.totals.total_rub", "base": "contract_base"}


def _field_sql(p: str, t: str, kind: str) -> str:
    if kind == "exact":
        score = f"CASE WHEN {_comparable(p)} = {_comparable(t)} THEN 100.0 ELSE 0.0 END"
    elif kind == "date":
        score = f"CASE WHEN {_date(p)} = {_date(t)} THEN 100.0 ELSE 0.0 END"
    else:
        x, y = _loose(p), _loose(t)
        score = f"CASE WHEN {x} IS NULL OR {y} IS NULL THEN 0.0 WHEN abs({x} - {y}) <= 0.01 THEN 100.0 ELSE round(greatest(0.0, 1 - abs({x} - {y}) / greatest(abs({y}), 1.0)) * 100, 2) END"
    return f"CASE WHEN {_blank(t)} AND {_blank(p)} THEN {{n: 0.0, w: 0.0, h: 0.0}} WHEN {_blank(t)} THEN {{n: 0.0, w: 0.0, h: 1.0}} WHEN {_blank(p)} THEN {{n: 0.0, w: 1.0, h: 0.0}} ELSE {{n: CAST({score} AS DOUBLE) / 100, w: 1.0, h: 0.0}} END"


_SCORED = [("doc_number", "exact"), ("doc_date", "date"), ("total", "money"), ("base", "exact")]


@query(f"""WITH p AS (SELECT payload_id, rec_id, CASE WHEN json_valid(payload) THEN payload END AS j FROM raw_payloads WHERE doc_type = 'invoices_upd'),
    x AS (SELECT payload_id, j ->> '$.doc_number' AS p_doc_number, j ->> '$.doc_date' AS p_doc_date, coalesce(j ->> '$.finances.total_rub', j ->> '$.finances.totals.total_rub') AS p_total, j ->> '$.contract_base' AS p_base,
        i.doc_number AS t_doc_number, i.doc_date AS t_doc_date, CAST(i.finances.total_rub AS VARCHAR) AS t_total, i.contract_base AS t_base, i.rec_id IS NOT NULL AS known
        FROM p LEFT JOIN invoices_upd i ON i.rec_id = p.rec_id),
    s AS (SELECT payload_id, known, [{', '.join(_field_sql(f'p_{f}', f't_{f}', k) for f, k in _SCORED)}] AS c FROM x),
    y AS (SELECT payload_id, known, list_sum(list_transform(c, lambda z: z.n)) AS n, list_sum(list_transform(c, lambda z: z.w)) AS w, list_sum(list_transform(c, lambda z: z.h)) AS h FROM s)
    SELECT payload_id, CASE WHEN known THEN 'benchmark' ELSE 'autonomous_no_ground_truth_match' END AS mode, CAST(w AS DOUBLE) AS truth_weight, CAST(h AS BIGINT) AS made_up,
        CAST(CASE WHEN w > 0 THEN round(greatest(0.0, least(100.0, (n - h) / w * 100)), 2) ELSE 0.0 END AS DOUBLE) AS overall FROM y""")
def q_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads against the records they were read into."""
    raw = table(spark, sf_dir, "raw_payloads").where("doc_type = 'invoices_upd'").select("payload_id", "rec_id", F.try_parse_json("payload").alias("v"))
    pred = raw.select("payload_id", "rec_id", *[paths.in_variant(F.col("v"), p).alias(n) for n, p in _PRED.items()])
    truth = table(spark, sf_dir, "invoices_upd").select("rec_id", "doc_number", "doc_date", F.col("finances.total_rub").alias("total"), F.col("contract_base").alias("base"), F.col("rec_id").alias("_seq"))
    joined = scoring.with_truth(pred, truth, "rec_id")
    scored = scoring.record_scores(joined, ["payload_id", "mode"], {f: (F.col(f), F.col(f"t_{f}"), k, 1.0) for f, k in _SCORED})
    return scored.select("payload_id", "mode", "truth_weight", F.size("made_up").cast("bigint").alias("made_up"), "overall")


_SCORES = "SELECT doc_type, count(*) AS records, round(avg(score), 2) AS mean_score, count(*) FILTER (known) AS with_truth, count(*) FILTER (score < 70) AS low, CAST(grouping(doc_type) AS INT) AS is_total, round(count(*) FILTER (known) * 100.0 / count(*), 2) AS truth_share"


@query(f"""{_SCORES} FROM (SELECT doc_type, CAST(CASE WHEN json_valid(payload) THEN 100.0 ELSE 0.0 END AS DOUBLE) AS score, rec_id IS NOT NULL AS known FROM raw_payloads) GROUP BY ROLLUP (doc_type)""")
def q_score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "raw_payloads").select("doc_type", F.when(F.try_parse_json("payload").isNotNull(), 100.0).otherwise(0.0).alias("score"), F.col("rec_id").isNotNull().alias("known"))
    return rollup.by_type(df.withColumn("status", text.score_status(F.col("score"))), "score", "status", "known")


_RULES = {"doc_number": "doc_number", "doc_date": "doc_date", "city": "city", "subject": "claim_subject", "total": "finances.total_claim_rub"}


@query("SELECT rec_id, round((" + " + ".join(f"CAST(NOT {_blank(f'CAST({p} AS VARCHAR)')} AS INT)" for p in _RULES.values()) + f") * 100.0 / {len(_RULES)}, 1) AS completeness FROM legal_claims")
def q_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "legal_claims")
    return df.select("rec_id", scoring.completeness(df, {n: ~blanks.is_blank(F.col(p).cast("string")) for n, p in _RULES.items()}).alias("completeness"))


# -- summaries

_AMOUNTS = {"enforcement_orders": "finances.total_rub", "executive_documents": "finances.total_rub", "salary_deductions": "finances.total_deduction_rub", "invoices_upd": "finances.total_rub", "commercial_contracts": "finances.total_rub", "legal_claims": "finances.total_claim_rub"}


@query("SELECT doc_type, count(*) AS records, count(*) FILTER (ok) AS verified, CAST(round(sum(coalesce(nullif(a, 0), 0.0)), 0) AS BIGINT) AS amount FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS doc_type, {c} AS a, processed_at IS NOT NULL AS ok FROM {t}" for t, c in _AMOUNTS.items()) + ") GROUP BY ROLLUP (doc_type)")
def q_money_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, t).select(F.lit(t).alias("doc_type"), F.col(c).alias("a"), F.col("processed_at").isNotNull().alias("ok")) for t, c in _AMOUNTS.items()]
    out = rollup.money_summary(reduce(DataFrame.unionByName, parts), [F.col("a")], F.col("ok"))
    return out.withColumn("amount", F.round("amount").cast("bigint"))


@query("""SELECT event_type, count(*) AS calls, count(*) FILTER (hit) AS cache_hits, count(*) FILTER (NOT hit) AS real_calls, round(avg(value) FILTER (NOT hit), 4) AS mean_latency, round(sum(k) FILTER (NOT hit) / nullif(sum(value) FILTER (NOT hit), 0), 4) AS tokens_per_s
    FROM (SELECT event_type, value, user_id % 5 = 0 AS hit, CAST(props ->> '$.k' AS BIGINT) AS k FROM events) GROUP BY event_type""")
def q_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as calls: every fifth user is served from the cache, values are latencies, ``k`` are tokens."""
    out = rollup.calls(table(spark, sf_dir, "events"), "event_type", F.col("user_id") % 5 == 0, "value", F.get_json_object("props", "$.k").cast("bigint"))
    return out.withColumn("mean_latency", F.round("mean_latency", 4)).withColumn("tokens_per_s", F.round("tokens_per_s", 4))


@query("SELECT event_id, user_id, count(*) OVER w AS running_n, CAST(sum(CAST(props ->> '$.k' AS BIGINT)) OVER w AS BIGINT) AS running_sum FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def q_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.running(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.get_json_object("props", "$.k").cast("bigint"), F.date_trunc("day", "ts")).select("event_id", "user_id", "running_n", "running_sum")


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS day, event_type, count(*) AS n, CAST(sum(CAST(props ->> '$.k' AS BIGINT)) AS BIGINT) AS tokens FROM events GROUP BY 1, 2")
def q_daily_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("tokens"))


@query("SELECT CASE WHEN min(r) IS NULL THEN 1 WHEN min(r) = 0 THEN 1 WHEN min(r) = 1 THEN 3 WHEN min(r) = 2 THEN 4 ELSE 0 END AS exit_code FROM (SELECT CASE WHEN NOT json_valid(payload) THEN 1 ELSE 3 END AS r FROM raw_payloads)")
def q_exit_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "raw_payloads").select(F.when(F.try_parse_json("payload").isNull(), 3).otherwise(0).alias("code"))
    return rollup.exit_code(df, F.col("code"))


# -- texts


@query(f"SELECT rec_id, {_comparable('claim_subject')} AS subject, {_comparable('court.base_decision')} AS decision FROM executive_documents")
def q_comparable(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "executive_documents")
    return df.select("rec_id", text.comparable(F.col("claim_subject")).alias("subject"), text.comparable(F.col("court.base_decision")).alias("decision"))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
    '(sk-[a-zA-Z0-9_\-]{8})[a-zA-Z0-9_\-]+', '\1***REDACTED***', 'g'), '(Bearer\s+[a-zA-Z0-9_\-.]{8})[a-zA-Z0-9_\-.]+', '\1***REDACTED***', 'g'),
    '(key[=:]\s*[''"]?)[a-zA-Z0-9_\-]{7,}', '\1***REDACTED***', 'g'), '(\b\d{4}\s+)\d{6}\b', '\1***REDACTED***', 'g')) AS digest FROM documents""")
def q_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.masked(F.col("text")).cast("binary")).alias("digest"))


def _word_after(x: str, words: str, value: str) -> str:
    """SQL of the first ``value`` after one of ``words``; the value ends where no more of its kind follows."""
    return f"nullif(regexp_extract({x}, '(?i)(?:{words})[\\s:№]*({value})(?:[^\\p{{L}}\\p{{N}}_]|$)', 1), '')"


def _alone(x: str, value: str) -> str:
    return f"nullif(regexp_extract({x}, '(?:^|[^\\p{{L}}\\p{{N}}_])({value})(?:[^\\p{{L}}\\p{{N}}_]|$)', 1), '')"


def _details_sql(key: str, x: str, source: str) -> str:
    words = {"bik": ("бик(?:\\s*тофк)?", "[0-9]{9}"), "account": ("казначейский\\s*счет|расчетный\\s*счет|р/с|счет|сч", "[0-9]{20}"), "inn": ("инн(?:\\s*получателя)?", "[0-9]{10}"), "kpp": ("кпп(?:\\s*получателя)?", "[0-9]{9}"), "oktmo": ("октмо", "[0-9]{8,11}"), "uin": ("уин", "[0-9]{20,25}")}
    bare = {"bik": ["0[1-4][0-9]{7}"], "account": ["03[12][0-9]{17}|401[0-9]{17}", "[0-9]{20}"], "uin": ["322[0-9]{17,22}"]}
    columns = [f"coalesce({', '.join([_word_after(x, *w), *[_alone(x, v) for v in bare.get(n, [])]])}) AS {n}" for n, w in words.items()]
    return f"SELECT {key}, {', '.join(columns)} FROM {source}"


@query(_details_sql("rec_id", "claimant.details", "enforcement_orders"))
def q_payment_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "enforcement_orders").select("rec_id", *[c.alias(n) for n, c in text.payment_details(F.col("claimant.details")).items()])


@query(_details_sql("doc_id", "text", "documents"))
def q_text_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in text.payment_details(F.col("text")).items()])


@query(r"""SELECT rec_id, coalesce(nullif(regexp_extract(base_doc, '(?i)(?:от|дата|выдан)[\s:]*([0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4})', 1), ''), nullif(regexp_extract(base_doc, '(?:^|[^\p{L}\p{N}_])([0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4})(?:[^\p{L}\p{N}_]|$)', 1), ''), '') AS base_date,
    coalesce(nullif(rtrim(regexp_extract(base_doc, '(?i)(?:№|номер|n)[\s:]*([a-zа-яё0-9_./-]+)', 1), '.'), ''), nullif(regexp_extract(base_doc, '[(]([A-Za-zА-Яа-яЁё0-9_./-]+)[)]', 1), ''), '') AS base_number FROM salary_deductions""")
def q_base_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.base_document(F.col("base_doc"))
    return table(spark, sf_dir, "salary_deductions").select("rec_id", found["date"].alias("base_date"), found["number"].alias("base_number"))


@query(r"""SELECT rec_id, CASE WHEN contains(ip_number, '/') THEN trim(ip_number) WHEN regexp_matches(ltrim(trim(ip_number), '№ '), '^[0-9]{11,13}-ИП$')
    THEN concat(substr(ltrim(trim(ip_number), '№ '), 1, 5), '/', substr(ltrim(trim(ip_number), '№ '), 6, 2), '/', substr(ltrim(trim(ip_number), '№ '), 8)) ELSE trim(ip_number) END AS ip_number,
    coalesce(nullif(regexp_extract(ip_number, '(?i)/([0-9]{5})-ИП', 1), ''), nullif(regexp_extract(ip_number, '(?:^|[^\p{L}\p{N}_])([0-9]{5})-ИП', 1), ''), '') AS office,
    CAST(CASE WHEN regexp_matches(ip_number, '[0-9]') AND contains(ip_number, '/') THEN 100 WHEN regexp_matches(ip_number, '[0-9]') AND length(ip_number) >= 4 THEN 80 ELSE 30 END AS DOUBLE) AS format_score FROM enforcement_orders""")
def q_file_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("ip_number")
    return table(spark, sf_dir, "enforcement_orders").select("rec_id", identifiers.case_file_number(n).alias("ip_number"), text.office_code(n).alias("office"), identifiers.file_number_score(n).alias("format_score"))


_PLACEHOLDERS = ", ".join(f"'{' '.join(x.split())}'" for x in identifiers.NO_KIND.split(";"))


@query("SELECT kind, count(*) AS n, bool_or(missing) AS missing FROM (" + " UNION ALL ".join(f"SELECT {c} AS kind, {c} IS NULL OR trim(regexp_replace(replace(lower({c}), 'ё', 'е'), '[^0-9a-zа-я]+', ' ', 'g')) IN ('', {_PLACEHOLDERS}) AS missing FROM {t}" for t, c in (("enforcement_orders", "court.doc_type"), ("commercial_contracts", "contract_type"), ("executive_documents", "court.court_type"))) + ") GROUP BY kind")
def q_missing_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, t).select(F.col(c).alias("kind")) for t, c in (("enforcement_orders", "court.doc_type"), ("commercial_contracts", "contract_type"), ("executive_documents", "court.court_type"))]
    return reduce(DataFrame.unionByName, parts).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.bool_or(identifiers.no_kind(F.col("kind"))).alias("missing"))


@query(r"""SELECT rec_id, CASE WHEN trim(coalesce(blank_series, '')) <> '' THEN regexp_matches(upper(trim(blank_series)), '^[А-ЯЁA-Z]{1,6}$') END AS series_ok,
    CASE WHEN trim(coalesce(blank_number, '')) <> '' THEN regexp_matches(trim(blank_number), '^[0-9]{6,12}$') END AS number_ok FROM executive_documents""")
def q_blank_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "executive_documents")
    return df.select("rec_id", identifiers.well_formed(F.col("blank_series"), "blank_series").alias("series_ok"), identifiers.well_formed(F.col("blank_number"), "blank_number").alias("number_ok"))


_SWEPT = {t: c for t, c in (("invoices_upd", ["doc_date"]), ("commercial_contracts", ["doc_date", "term_start", "term_end"]), ("legal_claims", ["doc_date", "contract_basis_date"]), ("executive_documents", ["act_date"]), ("enforcement_orders", ["doc_date", "court.act_date"]), ("salary_deductions", ["doc_date", "ip_date"]))}


@query("SELECT source_table, field_name, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS source_table, '{c}' AS field_name FROM {t} WHERE NOT {_blank(c)} AND {_date(c)} IS NULL" for t, cs in _SWEPT.items() for c in cs) + ") GROUP BY ALL")
def q_unparseable_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    def sweep(name: str) -> DataFrame:
        issues = audit.audited(table(spark, sf_dir, name), audit.Spec()).select(F.explode(F.filter("issues", lambda x: x["code"] == "UNPARSEABLE_DATE")).alias("i"))
        return issues.select(F.lit(name).alias("source_table"), F.col("i.field_name").alias("field_name"))

    return reduce(DataFrame.unionByName, [sweep(t) for t in _SWEPT]).groupBy("source_table", "field_name").agg(F.count(F.lit(1)).alias("n"))


# -- guardrails and formats

GUARDS = [("doc_number", "not_empty"), ("doc_date", "date_format"), ("sender.inn", "valid_inn"), ("finances.total_claim_rub", "positive_number"), ("city", "required")]


def _guard_sql(path: str, kind: str) -> str:
    x = f"CAST({path} AS VARCHAR)"
    filled = f"coalesce({_trim(x)}, '') <> ''"
    test = {"date_format": f"{_date(x)} IS NOT NULL", "valid_inn": _inn(x), "positive_number": f"{path} > 0"}.get(kind, "true")
    return f"CAST(({filled} AND coalesce({test}, false)) AS INT)"


@query("SELECT rec_id, p AS rules_passed, round(p * 100.0 / 5, 1) AS rule_score, p = 5 AS guard_passed FROM (SELECT rec_id, " + " + ".join(_guard_sql(*g) for g in GUARDS) + " AS p FROM legal_claims)")
def q_guardrails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guardrails.guarded(table(spark, sf_dir, "legal_claims"), GUARDS).select("rec_id", "rules_passed", "rule_score", "guard_passed")


_C, _AD = _trim("case_number"), _trim("act_date")


@query(rf"""SELECT rec_id, CAST(CASE WHEN coalesce(case_number, '') = '' THEN 0 WHEN f AND length({_C}) >= 6 AND NOT regexp_matches({_C}, '[/–-]') THEN 60 WHEN f THEN 100 ELSE 40 END AS DOUBLE) AS case_score,
    CAST(CASE WHEN coalesce(act_date, '') = '' THEN 0 WHEN regexp_matches({_AD}, '^\d{{4}}-\d{{2}}-\d{{2}}([T ]|$)') OR regexp_matches({_AD}, '(^|\D)\d{{1,2}}[./\-]\d{{1,2}}[./\-]\d{{2,4}}(\D|$)') THEN 100
        WHEN regexp_matches(lower({_AD}), '(?:{'|'.join(ns.split()[0][:-1] for m, ns in dates.MONTHS.items() if m != 5)})') OR regexp_matches(lower({_AD}), '(^|[^а-яёa-z0-9_])ма(?:я|е|й|ю)?([^а-яёa-z0-9_]|$)') THEN 95 ELSE 20 END AS DOUBLE) AS date_score,
    CAST(CASE WHEN coalesce(d, '') = '' THEN 0 WHEN regexp_extract(d, '(^|\D)(\d{{12}}|\d{{10}})(\D|$)', 2) = '' THEN 50 WHEN {_inn(r"regexp_extract(d, '(^|\D)(\d{12}|\d{10})(\D|$)', 2)")} THEN 100 ELSE 0 END AS DOUBLE) AS inn_score
    FROM (SELECT *, claimant.details AS d, regexp_matches({_C}, '^[А-Яа-я0-9A-Za-z\s\p{{Z}}№\-–—/.]+$') AND length({_C}) >= 4 AND regexp_matches({_C}, '[0-9]') AS f FROM executive_documents)""")
def q_format_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "executive_documents")
    return df.select("rec_id", guardrails.case_number_score(F.col("case_number")).alias("case_score"), guardrails.date_score(F.col("act_date")).alias("date_score"), guardrails.inn_in_text_score(F.col("claimant.details")).alias("inn_score"))


_PARTS = [f"finances.{c}" for c in ("main_debt_rub", "interest_penalty_rub", "court_fee_rub", "other_rub")]
_SUM, _ANY = " + ".join(f"coalesce({p}, 0.0::DOUBLE)" for p in _PARTS), " OR ".join(f"{p} IS NOT NULL" for p in _PARTS)


@query(f"""SELECT rec_id, CAST(CASE WHEN NOT has AND NOT filled THEN 100 WHEN has AND NOT filled THEN 95 WHEN has THEN CASE WHEN off <= 0.05 THEN 100 WHEN off <= 1.0 THEN 90 ELSE round(greatest(0.0, 1 - off / greatest(t, 1.0)) * 100, 2) END ELSE 90 END AS DOUBLE) AS balance
    FROM (SELECT rec_id, finances.total_rub AS t, coalesce(finances.total_rub > 0, false) AS has, ({_ANY}) AS filled, abs({_SUM} - finances.total_rub) AS off FROM executive_documents)""")
def q_balance_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "executive_documents")
    return df.select("rec_id", guardrails.balance_score(F.col("finances.total_rub"), *[F.col(p) for p in _PARTS]).alias("balance"))


@query("SELECT count(*) AS extracted, count(*) FILTER (late) AS escalated, count(*) FILTER (again) AS kept_first, count(*) FILTER (late) + count(*) FILTER (again) AS second_runs, round(count(*) FILTER (late) * 100.0 / count(*), 1) AS escalation_rate FROM (SELECT processed_at > received_at + INTERVAL '2 days' AS late, has_signature_stamp AS again, processed_at IS NOT NULL AS done FROM enforcement_orders) WHERE done")
def q_escalations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records processed late read as escalated ones."""
    df = table(spark, sf_dir, "enforcement_orders").select((F.col("processed_at") > F.col("received_at") + F.expr("INTERVAL '2' DAY")).alias("late"), F.col("has_signature_stamp").alias("again"), F.when(F.col("processed_at").isNull(), "FAILED").alias("status"))
    return recovery.escalations(df, "late", "again")


# -- projections


def _flat_sql() -> str:
    out = []
    for name, (kind, path) in flat.DEDUCTION.items():
        ways = [f"CASE WHEN NOT ({p} IS NULL OR {_trim(f'CAST({p} AS VARCHAR)')} IN ('', 'None', 'null', 'nan')) THEN {p} END" for p in path.split("|")]
        if kind == "number":
            out.append(f"coalesce({', '.join(ways)}, 0.0) AS {name}")
        elif kind == "date":
            out.append(f"coalesce(({_iso_of(ways[0])}), '') AS {name}")
        else:
            out.append(f"coalesce({', '.join(_trim(w) for w in ways)}, '') AS {name}")
    return f"SELECT rec_id, {', '.join(out)} FROM salary_deductions"


def _iso_of(x: str) -> str:
    s, a, b = _trim(x), r"(\d{1,2})[./\-](\d{1,2})[./\-](\d{4})", r"(\d{4})[./\-](\d{1,2})[./\-](\d{1,2})"
    put = lambda p, y, d: f"concat_ws('-', regexp_extract({s}, '{p}', {y}), lpad(regexp_extract({s}, '{p}', 2), 2, '0'), lpad(regexp_extract({s}, '{p}', {d}), 2, '0'))"
    return f"CASE WHEN regexp_matches({s}, '{a}') THEN {put(a, 3, 1)} WHEN regexp_matches({s}, '{b}') THEN {put(b, 1, 3)} ELSE {s} END"


@query(_flat_sql())
def q_flat_deductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat.flat(table(spark, sf_dir, "salary_deductions"), ["rec_id"], flat.DEDUCTION)


@query(f"SELECT rec_id, coalesce({', '.join(f'CASE WHEN NOT {_blank(p)} THEN {p} END' for p in ('party_one.inn', 'party_two.inn'))}) AS inn, CASE WHEN NOT {_blank('party_one.inn')} THEN 'party_one.inn' WHEN NOT {_blank('party_two.inn')} THEN 'party_two.inn' END AS found_at FROM commercial_contracts")
def q_first_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "commercial_contracts")
    found = paths.present_at(df.schema, "party_one.inn|party_two.inn")
    return df.select("rec_id", found["value"].alias("inn"), found["path"].alias("found_at"))


_LEAVES = ["doc_number", "doc_date", "city", "sender.name", "sender.inn", "sender.kpp", "sender.address", "recipient.name", "recipient.inn", "recipient.kpp", "recipient.address", "claim_subject", "finances.principal_debt_rub", "finances.penalty_rub", "finances.interest_rub", "finances.total_claim_rub", "finances.currency"]


@query(" UNION ALL ".join(f"SELECT '{p}' AS path, count(*) AS leaves, count({p}) AS filled FROM legal_claims WHERE " + (f"{p.split('.')[0]} IS NOT NULL" if "." in p else "true") for p in _LEAVES))
def q_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "legal_claims").select("rec_id", *dict.fromkeys(p.split(".")[0] for p in _LEAVES))
    return paths.leaves(df, "rec_id").groupBy("path").agg(F.count(F.lit(1)).alias("leaves"), F.count("value").alias("filled"))


# -- not expressible in SQL: checked against plain Python in the tests


@query()
def q_amounts_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", numbers.stated_amounts(F.col("text")).alias("_found")).select("doc_id", "_found.*")


@query()
def q_recovered_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of documents that state none, from their own text."""
    df = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit(None).cast("double").alias("total"), F.lit(None).cast("double").alias("debt"))
    return recovery.recovered(df, "text", ["total"], {"total": ("total_rub", "main_debt_rub"), "debt": ("main_debt_rub", None)}).select("doc_id", "total", "debt", "recovered")


@query()
def q_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the case number stands in the text."""
    return table(spark, sf_dir, "documents").select("doc_id", evidence.present(F.col("case_number"), F.col("text")).alias("borne_out"))


@query()
def q_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "executive_documents")
    return df.select("rec_id", text.similarity_score(F.col("claim_subject"), F.col("decision_summary")).alias("similarity"))


@query()
def q_salvaged_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "raw_payloads").select("payload_id", replies.json_of(F.col("payload")).alias("json"))


# -- rows for import, and the gate under noise

_PAY_TEXT = "concat_ws(' ', finances.periodic_details, claimant_details, debtor_details, notes, authority.address, claim_subject)"
_PAY_DETAILS = _details_sql("rec_id", "t", f"(SELECT rec_id, {_PAY_TEXT} AS t FROM salary_deductions)")


def _said(x: str) -> str:
    return f"CASE WHEN {_trim(x)} IN ('', 'None', 'null', 'nan') THEN NULL ELSE {_trim(x)} END"


def _iso(x: str) -> str:
    first, last = "([0-9]{1,2})[./-]([0-9]{1,2})[./-]([0-9]{4})", "([0-9]{4})[./-]([0-9]{1,2})[./-]([0-9]{1,2})"
    put = lambda p, y, d: f"concat_ws('-', regexp_extract({x}, '{p}', {y}), lpad(regexp_extract({x}, '{p}', 2), 2, '0'), lpad(regexp_extract({x}, '{p}', {d}), 2, '0'))"
    return f"CASE WHEN coalesce({x}, '') = '' THEN '' WHEN regexp_matches({x}, '{first}') THEN {put(first, 3, 1)} WHEN regexp_matches({x}, '{last}') THEN {put(last, 1, 3)} ELSE {x} END"


@query(rf"""WITH d AS ({_PAY_DETAILS}), b AS ({ORACLES['q_base_documents']}), o AS (SELECT rec_id, {_PAY_TEXT} AS t, {_said('authority.name')} AS head, {_said('doc_date')} AS day, * EXCLUDE (rec_id) FROM salary_deductions)
    SELECT o.rec_id AS rec_id, coalesce(d.bik, '') AS Bik, 10::INT AS DbCode, {_iso('b.base_date')} AS ExecutiveDocumentDate, coalesce(nullif(b.base_number, ''), {_said('o.doc_number')}, {_said('o.ip_number')}, '') AS ExecutiveDocumentNumber,
        coalesce(o.head, '') AS FSSP_Head, coalesce(d.oktmo, '') AS Oktmo, coalesce({_said('o.employer.name')}, '') AS OrganizationName, coalesce(d.account, '') AS PaymentAccount, 'ExecutiveProduction' AS PurposeType,
        coalesce(nullif(trim(regexp_extract(o.t, '(?i)(?:получател[ьяе]|в пользу)[\s:]*([^\n;,.]{{5,100}}[(][^)]+[)]|УФК[^\n;,]{{5,80}})', 1)), ''), 'УФК (' || o.head || ')', '') AS Recipient,
        coalesce(d.inn, '') AS RecipientInn, coalesce(d.kpp, '') AS RecipientKpp, {_iso('o.day')} AS ResolutionDate, coalesce({_said('o.authority.address')}, '') AS RospAddressFakt, coalesce({_said('o.authority.officer')}, '') AS RospBailiffFio,
        coalesce(nullif(regexp_extract(concat_ws(' ', {_said('o.ip_number')}, {_said('o.doc_number')}), '(?i)/([0-9]{{5}})-ИП', 1), ''), nullif(regexp_extract(concat_ws(' ', {_said('o.ip_number')}, {_said('o.doc_number')}), '(?i)(?:^|[^\p{{L}}\p{{N}}_])([0-9]{{5}})-ИП', 1), ''), nullif(regexp_extract(o.t, '(?i)(?:вксп|код|росп)[\s:]+([0-9]{{5}})(?:[^\p{{L}}\p{{N}}_]|$)', 1), ''), '') AS RospFullCode,
        coalesce(d.uin, '') AS Uin FROM o JOIN d USING (rec_id) JOIN b USING (rec_id)""")
def q_payment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat.payment_rows(table(spark, sf_dir, "salary_deductions"), ["rec_id"])


def q_gate_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often true parties and numbers of claims are doubted when their text is misread; its own rows, no SQL can draw the noise."""
    spec = audit.Spec(gate_fields={"sender.inn": 10, "recipient.inn": 10, "doc_number": 3}, gate_names=["sender.name", "recipient.name"])
    body = F.concat_ws(" ", F.lit("Претензия от отправителя"), "sender.name", F.lit("ИНН"), "sender.inn", F.lit("получателю"), "recipient.name", F.lit("ИНН"), "recipient.inn", F.lit("номер"), "doc_number")
    return measure.gate_curve(table(spark, sf_dir, "legal_claims"), spec, body, "rec_id", [0.0, 0.01, 0.02, 0.05, 0.1])


QUERIES["q_gate_curve"] = q_gate_curve
