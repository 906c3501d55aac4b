"""Queries of problem 4 over the record tables and the raw payloads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from paperloom.operators import nested
from paperloom.session import table

TYPED = ("invoices_upd", "commercial_contracts", "legal_claims")


def _nodes(spark: SparkSession, sf_dir: str, fields: bool) -> DataFrame:
    parts = [nested.objects_of(table(spark, sf_dir, t), "rec_id", t, fields) for t in TYPED]
    parts.append(nested.json_objects_of(table(spark, sf_dir, "raw_payloads"), "payload_id", "payload", "raw_payloads", fields))
    return reduce(DataFrame.unionByName, parts)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every object below the root, with its place and its parent."""
    return _nodes(spark, sf_dir, False)


def p4_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.documents_table(_nodes(spark, sf_dir, True))


def p4_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.parties_table(_nodes(spark, sf_dir, True))


def p4_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.items_table(_nodes(spark, sf_dir, True))


def p4_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.totals_table(_nodes(spark, sf_dir, True))


QUERIES = {f.__name__: f for f in (p4_found, p4_documents, p4_parties, p4_items, p4_totals)}

# The walk over JSON, level by level; a text that is an object or array from end to end stands for it.
_OPENED = "CASE WHEN e.type = 'VARCHAR' AND json_valid(e.value ->> '$') AND json_type(e.value ->> '$') IN ('OBJECT', 'ARRAY') THEN (e.value ->> '$')::JSON ELSE e.value END"
_WALK = f"""walk(rec_id, path, parent, v) AS (
    SELECT payload_id, '', '$', payload::JSON FROM raw_payloads WHERE json_valid(payload)
    UNION ALL
    SELECT w.rec_id, CASE WHEN json_type(w.v) = 'ARRAY' THEN w.path || '[' || e.key || ']' WHEN w.path = '' THEN e.key ELSE w.path || '.' || e.key END,
        CASE WHEN json_type(w.v) = 'ARRAY' THEN w.parent WHEN w.path = '' THEN '$' ELSE w.path END, {_OPENED}
    FROM walk w, json_each(w.v) e WHERE json_type({_OPENED}) IN ('OBJECT', 'ARRAY'))"""
_MEMBERS = {"invoices_upd": ["seller", "buyer", "finances"], "commercial_contracts": ["party_one", "party_two", "finances"], "legal_claims": ["sender", "recipient", "finances"]}
_OBJECTS = " UNION ALL ".join(f"SELECT '{t}' AS source_table, rec_id, '{m}' AS node_path, '$' AS parent_path FROM {t} WHERE {m} IS NOT NULL" for t, ms in _MEMBERS.items() for m in ms)
_ITEMS = "SELECT 'invoices_upd', rec_id, 'items[' || (i - 1) || ']', '$' FROM (SELECT rec_id, unnest(items) AS x, generate_subscripts(items, 1) AS i FROM invoices_upd) WHERE x IS NOT NULL"
FOUND_SQL = f"WITH RECURSIVE {_WALK} {_OBJECTS} UNION ALL {_ITEMS} UNION ALL SELECT 'raw_payloads', rec_id, path, parent FROM walk WHERE path <> '' AND json_type(v) = 'OBJECT'"


def q_typed_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parties of the record tables, without those of payloads."""
    parts = [nested.objects_of(table(spark, sf_dir, t), "rec_id", t, True) for t in TYPED]
    return nested.parties_table(reduce(DataFrame.unionByName, parts)).select("source_table", "rec_id", "node_path", "parent_path", "role", "name", "inn", "kpp", "ogrn", "stated_role")


def q_typed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of invoices."""
    nodes = nested.objects_of(table(spark, sf_dir, "invoices_upd"), "rec_id", "invoices_upd", True)
    return nested.items_table(nodes).select("source_table", "rec_id", "node_path", "parent_path", "name", "unit", "vat_rate", "quantity", "price", "amount_no_vat", "vat_amount", "total_amount")


def q_typed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The amounts of the record tables."""
    parts = [nested.objects_of(table(spark, sf_dir, t), "rec_id", t, True) for t in TYPED]
    return nested.totals_table(reduce(DataFrame.unionByName, parts)).drop("fields")


def _party_sql(t: str, m: str) -> str:
    extra = ("ogrn", "role") if t == "commercial_contracts" else ()
    cells = ", ".join(f"{m}.{c} AS {a}" if c not in ("ogrn", "role") or c in extra else f"NULL::VARCHAR AS {a}" for c, a in (("name", "name"), ("inn", "inn"), ("kpp", "kpp"), ("ogrn", "ogrn"), ("role", "stated_role")))
    return f"SELECT '{t}' AS source_table, rec_id, '{m}' AS node_path, '$' AS parent_path, '{m}' AS role, {cells} FROM {t} WHERE {m} IS NOT NULL"


_AMOUNTS = {"invoices_upd": ["total_rub_no_vat", "total_vat_rub", "total_rub"], "commercial_contracts": ["total_rub", "vat_amount_rub"], "legal_claims": ["principal_debt_rub", "penalty_rub", "interest_rub", "total_claim_rub"]}
ORACLES: dict[str, str] = {
    "p4_found": FOUND_SQL,
    "q_typed_parties": " UNION ALL ".join(_party_sql(t, m) for t, ms in _MEMBERS.items() for m in ms if m != "finances"),
    "q_typed_items": "SELECT 'invoices_upd' AS source_table, rec_id, 'items[' || (i - 1) || ']' AS node_path, '$' AS parent_path, x.name AS name, x.unit AS unit, x.vat_rate AS vat_rate, x.quantity AS quantity, x.price AS price, x.amount_no_vat AS amount_no_vat, x.vat_amount AS vat_amount, x.total_amount AS total_amount FROM (SELECT rec_id, unnest(items) AS x, generate_subscripts(items, 1) AS i FROM invoices_upd) WHERE x IS NOT NULL",
    "q_typed_totals": " UNION ALL ".join(f"SELECT '{t}' AS source_table, rec_id, 'finances' AS node_path, '$' AS parent_path, finances.currency AS currency, '{m}' AS measure, finances.{m} AS amount FROM {t} WHERE finances IS NOT NULL" for t, ms in _AMOUNTS.items() for m in ms),
}
QUERIES |= {f.__name__: f for f in (q_typed_parties, q_typed_items, q_typed_totals)}
