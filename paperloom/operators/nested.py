"""Nested records as related flat tables (problem 4).

Every table is a projection: nested ``transform`` calls hand the ancestor's path and position down, ``flatten``
joins the arrays and one ``inline`` emits the rows of a target table. Nothing is shuffled, and a record's rows
stay with the task that read it. Typed records are unrolled from their schema. JSON of any shape is unrolled
level by level inside one ``aggregate`` over variants, which ends at the depth the text itself bounds.

Null structs and null array elements give no row, but keep their place in the numbering. Empty objects give a
row. Text that isn't valid JSON, and null, gives none. Equal records and equal elements all keep their rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = "$"
NODE = "array<struct<node_path:string,parent_path:string>>"
FULL_NODE = "array<struct<node_path:string,parent_path:string,fields:map<string,string>>>"
#: The member that may be an object of texts in place of a text.
NAME = "name"
#: The members of the record types that hold parties; those whose objects have rows in a table that carries them whole.
PARTIES = ["seller", "buyer", "party_one", "party_two", "sender", "recipient"]
OWN = [*PARTIES, "items"]


def _none(fields: bool = False) -> Column:
    return F.array().cast(FULL_NODE if fields else NODE)


def _under(path: Column | None, key: str) -> Column:
    return F.lit(key) if path is None else F.concat(path, F.lit("." + key))


def _at(path: Column, i: Column) -> Column:
    return F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))


def _text(value: Column, dtype: T.DataType) -> Column:
    return F.to_json(value) if isinstance(dtype, (T.ArrayType, T.MapType)) else value.cast("string")


def _listed(value: Column, field: T.StructField) -> Column:
    return F.transform(value, lambda x, i: F.struct(_at(F.lit(field.name), i).alias("key"), _text(x, field.dataType.elementType).alias("value")))


def _scalars(get, dtype: T.StructType, root: bool = False) -> Column:
    """An object's scalars as text by name; those of lists as ``name[i]``, those of its name, if an object, as ``name.x``.

    Of a root also the objects and lists, as JSON, that are no parties or items.
    """
    if root:
        whole = [(f.name, F.to_json(get(f.name))) for f in dtype.fields if isinstance(f.dataType, (T.StructType, T.ArrayType)) and f.name not in OWN]
        rest = F.create_map(*[x for n, c in whole for x in (F.lit(n), c)]).cast("map<string,string>")
        return F.map_concat(_scalars(get, T.StructType([f for f in dtype.fields if f.name not in [n for n, _ in whole]])), rest)
    pairs = [(F.lit(f.name), _text(get(f.name), f.dataType)) for f in dtype.fields if not isinstance(f.dataType, (T.StructType, T.ArrayType))]
    inner = [(f.name, g) for f in dtype.fields if f.name == NAME and isinstance(f.dataType, T.StructType) for g in f.dataType.fields if not isinstance(g.dataType, (T.StructType, T.ArrayType))]
    taken = [f.name for f in dtype.fields]
    pairs += [(F.lit(f"{n}.{g.name}"), _text(get(n).getField(g.name), g.dataType)) for n, g in inner if f"{n}.{g.name}" not in taken]
    fields = F.create_map(*[x for p in pairs for x in p]).cast("map<string,string>")
    lists = [f for f in dtype.fields if isinstance(f.dataType, T.ArrayType) and not _holds_objects(f.dataType)]
    kept = [F.filter(_listed(get(f.name), f), lambda e: e["value"].isNotNull() & ~e["key"].isin(taken)) for f in lists]
    return F.map_concat(fields, *[F.coalesce(F.map_from_entries(x), F.create_map().cast("map<string,string>")) for x in kept]) if kept else fields


def typed_nodes(value: Column, dtype: T.DataType, path: Column, parent: Column, fields: bool = False) -> Column:
    """Array of (node_path, parent_path[, fields]) of the objects in ``value``, which stands at ``path``."""
    if isinstance(dtype, T.StructType):
        own = [path.alias("node_path"), parent.alias("parent_path"), *[_scalars(value.getField, dtype).alias("fields")] * fields]
        parts = [typed_nodes(value.getField(f.name), f.dataType, _under(path, f.name), path, fields) for f in dtype.fields if _holds_objects(f.dataType)]
        return F.when(value.isNotNull(), F.concat(F.array(F.struct(*own)), *parts)).otherwise(_none(fields))
    if isinstance(dtype, T.ArrayType) and _holds_objects(dtype.elementType):
        each = F.transform(value, lambda x, i: typed_nodes(x, dtype.elementType, _at(path, i), parent, fields))
        return F.coalesce(F.flatten(each), _none(fields))
    return _none(fields)


def _holds_objects(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.StructType) or isinstance(dtype, T.ArrayType) and _holds_objects(dtype.elementType)


def objects_of(df: DataFrame, key: str, source: str, fields: bool = False) -> DataFrame:
    """(source_table, rec_id, node_path, parent_path[, fields]) for each object below the root of typed records.

    ``key`` names the record's id; columns of other names, whatever they are called, are records' fields. With
    ``fields``, the root has a row too (``$``, no parent), and each row the object's scalars as text: those of a list
    as ``marks[0]`` (a list in a list as JSON), those of a ``name`` that is an object also as ``name.ru``. A member
    that is itself called so keeps its value. The root also has its objects and lists that are no parties or items, as JSON.
    """
    parts = [typed_nodes(F.col(f"`{f.name}`"), f.dataType, F.lit(f.name), F.lit(ROOT), fields) for f in df.schema.fields if _holds_objects(f.dataType)]
    if fields:
        parts.insert(0, F.array(F.struct(F.lit(ROOT).alias("node_path"), F.lit(None).cast("string").alias("parent_path"), _scalars(lambda n: F.col(f"`{n}`"), df.schema, True).alias("fields"))))
    nodes = F.concat(*parts) if parts else _none(fields)
    return df.select(F.lit(source).alias("source_table"), F.col(f"`{key}`").alias("rec_id"), F.inline(nodes))


def _depth_bound(text: str) -> str:
    """SQL: levels that the JSON text can have at most: its brackets outside strings, as nested, and those within."""
    bare = f"regexp_replace({text}, '\\\\\\\\.', '')"
    outside = f"regexp_replace(regexp_replace({bare}, '\"[^\"]*\"', ''), '[^\\\\[\\\\]{{}}]', '')"
    deepest = f"""aggregate(split({outside}, ''), named_struct('now', 0, 'top', 0),
        (a, c) -> named_struct('now', a.now + CASE WHEN c IN ('[', '{{') THEN 1 WHEN c IN (']', '}}') THEN -1 ELSE 0 END,
            'top', greatest(a.top, a.now + CASE WHEN c IN ('[', '{{') THEN 1 ELSE 0 END)), a -> a.top)"""
    inside = f"length(regexp_replace({text}, '[^\\\\[{{]', '')) - length(regexp_replace({outside}, '[^\\\\[{{]', ''))"
    return f"({deepest} + {inside})"


def _whole_json(text: str) -> str:
    """SQL: the variant of a text that is one JSON value from end to end; the parser alone lets words follow the value."""
    alone = f"try_cast(try_parse_json(concat('[', {text}, ']')) AS array<variant>)"
    return f"CASE WHEN size({alone}) = 1 AND try_parse_json(concat('{{\"v\":', {text}, '}}')) IS NOT NULL THEN {alone}[0] END"


#: A level's values: kind o (object), a (array) or s (anything else); a string that is JSON stands for its content.
_OPEN = "CASE WHEN try_cast({v} AS map<string, variant>) IS NULL AND try_cast({v} AS array<variant>) IS NULL THEN {parsed} ELSE {v} END"


def json_objects_of(df: DataFrame, key: str, payload: str, source: str, fields: bool = False) -> DataFrame:
    """(source_table, rec_id, node_path, parent_path[, fields]) for each object below the root of JSON texts; see :func:`objects_of`."""
    node = FULL_NODE if fields else NODE
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")  # of equal keys the last holds, as JSON readers do
    opened = _OPEN.format(v="c.v", parsed="CASE WHEN ltrim(try_cast(c.v AS string)) RLIKE '^[\\\\[{]' AND schema_of_variant(c.v) = 'STRING' THEN " + _whole_json("try_cast(c.v AS string)") + " END")
    children = """flatten(transform(a.front, n -> CASE
        WHEN n.o IS NOT NULL THEN transform(map_entries(n.o), e -> named_struct(
            'path', CASE WHEN n.path = '' THEN e.key ELSE concat(n.path, '.', e.key) END,
            'parent', CASE WHEN n.path = '' THEN '$' ELSE n.path END, 'v', e.value))
        WHEN n.a IS NOT NULL THEN transform(n.a, (x, i) -> named_struct(
            'path', concat(n.path, '[', i, ']'), 'parent', n.parent, 'v', x))
        END))"""
    next_front = f"""filter(transform(transform({children}, c -> named_struct('path', c.path, 'parent', c.parent, 'v', {opened})),
        c -> named_struct('path', c.path, 'parent', c.parent, 'o', try_cast(c.v AS map<string, variant>), 'a', try_cast(c.v AS array<variant>))),
        c -> c.o IS NOT NULL OR c.a IS NOT NULL)"""
    front_type = "array<struct<path:string,parent:string,o:map<string,variant>,a:array<variant>>>"
    root = f"CAST(array(named_struct('path', '', 'parent', '$', 'o', try_cast(_v AS map<string, variant>), 'a', try_cast(_v AS array<variant>))) AS {front_type})"
    kind_o, kind_a = "try_cast({0} AS map<string, variant>) IS NOT NULL", "try_cast({0} AS array<variant>) IS NOT NULL"
    open_x = f"coalesce({opened.replace('c.v', 'x')}, x)"
    # A list in a list has its place in the text of the outer one; lists of nothing but objects have their rows.
    leaf = f"CASE WHEN {kind_o.format('y')} THEN NULL WHEN {kind_a.format('y')} THEN CASE WHEN NOT schema_of_variant(y) RLIKE '^(ARRAY<)+(OBJECT|VOID)' THEN to_json(y) END ELSE try_cast(y AS string) END"
    pair = "CAST({0} AS array<struct<key:string,value:string>>)"
    listed = f"transform(transform(try_cast(e.value AS array<variant>), x -> {open_x}), (y, i) -> named_struct('key', concat(e.key, '[', i, ']'), 'value', {leaf}))"
    inside = f"transform(map_entries(try_cast(e.value AS map<string, variant>)), d -> named_struct('key', concat(e.key, '.', d.key), 'value', CASE WHEN {kind_o.format('d.value')} OR {kind_a.format('d.value')} THEN NULL ELSE try_cast(d.value AS string) END))"
    own = ", ".join(f"'{n}'" for n in OWN)
    members = f"""flatten(transform(map_entries(transform_values(n.o, (k, x) -> {open_x})), e -> CASE
        WHEN n.path = '' AND NOT e.key IN ({own}) AND ({kind_o.format("e.value")} OR {kind_a.format("e.value")}) THEN {pair.format("array(named_struct('key', e.key, 'value', to_json(e.value)))")}
        WHEN {kind_o.format("e.value")} THEN CASE WHEN e.key = '{NAME}' THEN filter({pair.format(inside)}, p -> NOT map_contains_key(n.o, p.key)) ELSE {pair.format("array()")} END
        WHEN {kind_a.format("e.value")} THEN filter({pair.format(listed)}, p -> NOT map_contains_key(n.o, p.key))
        ELSE {pair.format("array(named_struct('key', e.key, 'value', try_cast(e.value AS string)))")} END))"""
    scalars = f"map_from_entries(filter({members}, p -> p.value IS NOT NULL))"
    if fields:
        row = f"named_struct('node_path', CASE WHEN n.path = '' THEN '$' ELSE n.path END, 'parent_path', CASE WHEN n.path <> '' THEN n.parent END, 'fields', {scalars})"
        seen = f"CAST(transform(filter(a.front, n -> n.o IS NOT NULL), n -> {row}) AS {node})"
    else:
        seen = f"CAST(transform(filter(a.front, n -> n.o IS NOT NULL AND n.path <> ''), n -> named_struct('node_path', n.path, 'parent_path', n.parent)) AS {node})"
    walked = f"""aggregate(sequence(0, _depth), named_struct('front', {root}, 'seen', CAST(array() AS {node})),
        (a, k) -> CASE WHEN size(a.front) = 0 THEN a ELSE named_struct('front', CAST({next_front} AS {front_type}), 'seen', concat(a.seen, {seen})) END, a -> a.seen)"""
    parsed = df.select(F.col(f"`{key}`").alias("rec_id"), F.col(f"`{payload}`").alias("_text")).where(F.col("_text").isNotNull())
    parsed = parsed.withColumn("_v", F.expr(_whole_json("_text"))).where(F.col("_v").isNotNull())
    parsed = parsed.withColumn("_depth", F.expr(_depth_bound("_text")))
    return parsed.select(F.lit(source).alias("source_table"), "rec_id", F.inline(F.expr(walked)))


# The marks of items and of totals in a path, and the columns of documents and of parties.
ITEM = r"^items($|[.\[])"
TOTAL = r"^finances(\.totals|\.breakdown\[\d+\])?$"
DOCUMENT = ["doc_type", "doc_number", "doc_date", "file_path", "file_name", "status", "city", "contract_base", "contract_type", "claim_subject", "term_start", "term_end", "contract_basis_number", "contract_basis_date", "bank_requisites", "response_deadline_days", "has_signature_stamp"]
PARTY = ["name", "inn", "kpp", "ogrn", "address", "signatory_fio", "signatory_basis"]


def _field(*names: str) -> Column:
    return F.coalesce(*[F.col("fields")[n] for n in names])


def amount(text: Column) -> Column:
    """A number written in text: blanks and words dropped, the last separator being the decimal one."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?i)руб.*$", ""), r"[^\d,.\-]", "")
    both = F.when(bare.rlike(r",.*\."), F.regexp_replace(bare, ",", "")).otherwise(F.translate(F.regexp_replace(bare, r"\.(?=.*,)", ""), ",", "."))
    return both.try_cast("double")


def documents_table(nodes: DataFrame) -> DataFrame:
    """One row for each document: the roots. ``fields`` has all that they hold besides parties and items, objects and lists as JSON."""
    return nodes.where(F.col("node_path") == ROOT).select("source_table", "rec_id", "node_path", *[_field(n).alias(n) for n in DOCUMENT], "fields")


def parties_table(nodes: DataFrame) -> DataFrame:
    """One row for each party, also where a mere name stands in the object's place, and for each object within a party.

    Details kept deeper (``requisites``, ``bank``, accounts, shares) have their own rows, with their parents. ``role`` is
    the member that holds the party, ``stated_role`` the role that a contract gives it; ``fields`` has all scalars.
    """
    of = F.regexp_extract("node_path", rf"^({'|'.join(PARTIES)})($|[.\[])", 1)
    cells = [_field(n, f"{n}.ru").alias(n) if n == NAME else _field(n).alias(n) for n in PARTY]
    own = nodes.where(of != "").select("source_table", "rec_id", "node_path", "parent_path", of.alias("role"), *cells, _field("role").alias("stated_role"), "fields")
    named = F.filter(F.map_entries("fields"), lambda e: e["key"].rlike(rf"^({'|'.join(PARTIES)})(\[\d+\])*$") & e["value"].isNotNull())
    bare = nodes.where(F.col("node_path") == ROOT).select("source_table", "rec_id", F.inline(named).alias("node_path", NAME))
    return own.unionByName(bare.withColumns({"parent_path": F.lit(ROOT), "role": F.regexp_extract("node_path", r"^\w+", 0), "fields": F.create_map().cast("map<string,string>")}), allowMissingColumns=True)


def items_table(nodes: DataFrame) -> DataFrame:
    """One row for each item and for each object within an item (parts, makers, ...), which has the item as its parent.

    A name that is an object has its row, too; the item's name is its Russian text. ``fields`` has all scalars.
    """
    amounts = [amount(_field(n)).alias(n) for n in ("quantity", "price", "amount_no_vat", "vat_amount", "total_amount")]
    return nodes.where(F.col("node_path").rlike(ITEM)).select("source_table", "rec_id", "node_path", "parent_path", _field("row_num").alias("row_num"), _field(NAME, f"{NAME}.ru").alias("name"), _field("unit").alias("unit"), _field("vat_rate").alias("vat_rate"), *amounts, "fields")


def totals_table(nodes: DataFrame) -> DataFrame:
    """One row for each amount of an object of amounts: its name and the amount; ``fields`` has all scalars of the object."""
    long = nodes.where(F.col("node_path").rlike(TOTAL)).select("source_table", "rec_id", "node_path", "parent_path", _field("currency").alias("currency"), "fields", F.explode("fields").alias("measure", "text"))
    return long.where(F.col("measure").rlike("(_rub|_no_vat|^sum)$|^total")).select("source_table", "rec_id", "node_path", "parent_path", "currency", "measure", amount(F.col("text")).alias("amount"), "fields")
