import json

from pyspark.sql import functions as F

from paperloom.operators import audit, flat, guardrails, measure, nested, recovery, registry, rollup, routing, scoring


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# -- nested records


def plain(value, path, parent, out):
    """The objects of parsed JSON, in plain Python."""
    if isinstance(value, str) and value.strip()[:1] in ("[", "{"):
        try:
            value = json.loads(value)
        except ValueError:
            return
    if isinstance(value, dict):
        if path is not None:
            out.append((path, parent))
        for k, x in value.items():
            plain(x, k if path is None else f"{path}.{k}", "$" if path is None else path, out)
    elif isinstance(value, list):
        for i, x in enumerate(value):
            plain(x, f"{path or ''}[{i}]", parent, out)


def test_json_objects_agree_with_plain_python(spark, tiny):
    raw = spark.read.parquet(f"{tiny}/raw_payloads.parquet").select("payload_id", "payload")
    extra = ['{"a":{}} x', '{"a":{"b":"[{}]"}}', None, "", "[[{}],{\"k\":{\"x\":1}}]", '{"a":"{"}', '{"a":"}}}]]]{[", "b":{"c":[[{"d":"[[[{\\"e\\":[{}]}]]]"}]]}}', '{"a": {"b"', "null", "1", '{"a":1,"a":{"b":{}}}', "[1] , [2", '1}, {"x": {}', '{"a": {}}, {}', '{"x.y": {"z": {}}}', "[" * 40 + "{}" + "]" * 40]
    df = raw.unionByName(spark.createDataFrame([(-i, x) for i, x in enumerate(extra, 1)], raw.schema))
    want = []
    for r in df.collect():
        try:
            out = []
            plain(json.loads(r["payload"]), None, "$", out)
            want += [("raw", r["payload_id"], *x) for x in out]
        except (ValueError, TypeError):
            continue
    assert rows(nested.json_objects_of(df, "payload_id", "payload", "raw")) == sorted(want, key=repr)


def test_typed_objects_keep_places_and_parents(spark):
    df = spark.createDataFrame([(1, ("a", None), [(1, [("x",)]), None, (1, [("x",)])]), (2, None, None), (3, ("b", ("c",)), [])], "id long, source_table struct<n:string,in:struct<m:string>>, node_path array<struct<i:int,sub:array<struct<s:string>>>>")
    got = rows(nested.objects_of(df, "id", "t"))
    assert got == sorted([
        ("t", 1, "source_table", "$"), ("t", 1, "node_path[0]", "$"), ("t", 1, "node_path[0].sub[0]", "node_path[0]"), ("t", 1, "node_path[2]", "$"),
        ("t", 1, "node_path[2].sub[0]", "node_path[2]"), ("t", 3, "source_table", "$"), ("t", 3, "source_table.in", "source_table"),
    ], key=repr)
    assert nested.objects_of(df.limit(0), "id", "t").count() == 0


def test_flat_tables_know_document_and_parent(spark):
    payload = {"doc_number": "1", "seller": "ООО «Альфа»", "buyer": {"name": "Б", "requisites": {"inn": "77"}}, "items": [{"name": "x", "amount_no_vat": "1 801,96 руб.", "components": [{"name": "y"}]}, None], "finances": {"totals": {"total_rub": "1,439.50"}, "currency": "RUB"}}
    nodes = nested.json_objects_of(spark.createDataFrame([(7, json.dumps(payload, ensure_ascii=False))], "id long, p string"), "id", "p", "raw", True)
    assert [(r["node_path"], r["doc_number"]) for r in nested.documents_table(nodes).collect()] == [("$", "1")]
    assert {(r["node_path"], r["parent_path"], r["name"], r["inn"]) for r in nested.parties_table(nodes).collect()} == {("buyer", "$", "Б", None), ("buyer.requisites", "buyer", None, "77"), ("seller", "$", "ООО «Альфа»", None)}
    assert {(r["node_path"], r["parent_path"], r["amount_no_vat"]) for r in nested.items_table(nodes).collect()} == {("items[0]", "$", 1801.96), ("items[0].components[0]", "items[0]", None)}
    assert [(r["node_path"], r["measure"], r["amount"]) for r in nested.totals_table(nodes).collect()] == [("finances.totals", "total_rub", 1439.5)]


def test_items_keep_names_and_details_that_are_objects(spark):
    item = {"name": {"ru": "Труба", "code": "5"}, "marks": ["A1", None, ["B", "C"]], "components": [{"name": "y", "maker": {"country": "РФ"}}], "unit": '{"k": "кг"}'}
    nodes = nested.json_objects_of(spark.createDataFrame([(7, json.dumps({"items": [item, '{"name": "z"}', "w"]}, ensure_ascii=False))], "id long, p string"), "id", "p", "raw", True)
    got = {r["node_path"]: (r["parent_path"], r["name"], r["unit"], r["fields"]) for r in nested.items_table(nodes).collect()}
    assert got == {
        "items[0]": ("$", "Труба", None, {"name.ru": "Труба", "name.code": "5", "marks[0]": "A1", "marks[2]": '["B","C"]'}),
        "items[0].name": ("items[0]", None, None, {"ru": "Труба", "code": "5"}),
        "items[0].unit": ("items[0]", None, None, {"k": "кг"}),
        "items[0].components[0]": ("items[0]", "y", None, {"name": "y"}),
        "items[0].components[0].maker": ("items[0].components[0]", None, None, {"country": "РФ"}),
        "items[1]": ("$", "z", None, {"name": "z"}),
    }
    typed = spark.createDataFrame([(1, [(("Труба", "5"), ["A1", None])])], "id long, items array<struct<name:struct<ru:string,code:string>,marks:array<string>>>")
    got = {r["node_path"]: (r["name"], r["fields"]) for r in nested.items_table(nested.objects_of(typed, "id", "t", True)).collect()}
    assert got == {"items[0]": ("Труба", {"name.ru": "Труба", "name.code": "5", "marks[0]": "A1"}), "items[0].name": (None, {"ru": "Труба", "code": "5"})}


def test_documents_and_parties_keep_all_they_hold(spark):
    buyer = [{"name": "А", "role": "Покупатель", "signatory_fio": "Иванов И.И.", "share": {"num": 1, "den": 2}}, "ООО «Б»"]
    seller = {"requisites": {"signatory_basis": "Устав", "bank": {"title": "банк", "accounts": [{"no": "5"}]}}}
    payload = {"city": "К", "term_end": "04.03.2016", "response_deadline_days": 10, "other": "x", "buyer": buyer, "seller": json.dumps(seller), "meta": {"tags": ["x"], "ocr": [{"no": 1}]}, "finances": {"breakdown": [{"kind": "долг", "sum": 5}]}}
    nodes = nested.json_objects_of(spark.createDataFrame([(7, json.dumps(payload, ensure_ascii=False))], "id long, p string"), "id", "p", "raw", True)
    (document,) = nested.documents_table(nodes).collect()
    assert (document["city"], document["term_end"], document["response_deadline_days"], document["contract_base"]) == ("К", "04.03.2016", "10", None)
    rest = {"other": "x", "buyer[1]": "ООО «Б»", "meta": '{"ocr":[{"no":1}],"tags":["x"]}', "finances": '{"breakdown":[{"kind":"долг","sum":5}]}'}
    assert {k: v for k, v in document["fields"].items() if k not in ("city", "term_end", "response_deadline_days")} == rest
    parties = nested.parties_table(nodes).collect()
    got = {r["node_path"]: (r["parent_path"], r["role"], r["stated_role"], r["name"], r["signatory_fio"], r["signatory_basis"], r["fields"]) for r in parties}
    assert len(parties) == len(got) and got == {
        "buyer[0]": ("$", "buyer", "Покупатель", "А", "Иванов И.И.", None, {"name": "А", "role": "Покупатель", "signatory_fio": "Иванов И.И."}),
        "buyer[0].share": ("buyer[0]", "buyer", None, None, None, None, {"num": "1", "den": "2"}),
        "buyer[1]": ("$", "buyer", None, "ООО «Б»", None, None, {}),
        "seller": ("$", "seller", None, None, None, None, {}),
        "seller.requisites": ("seller", "seller", None, None, None, "Устав", {"signatory_basis": "Устав"}),
        "seller.requisites.bank": ("seller.requisites", "seller", None, None, None, None, {"title": "банк"}),
        "seller.requisites.bank.accounts[0]": ("seller.requisites.bank", "seller", None, None, None, None, {"no": "5"}),
    }
    assert [(r["measure"], r["amount"], r["fields"]["kind"]) for r in nested.totals_table(nodes).collect()] == [("sum", 5.0, "долг")]
    typed = spark.createDataFrame([(1, "К", ("А", "Поставщик"), (5.0, True))], "id long, city string, party_one struct<name:string,role:string>, finances struct<total_rub:double,vat_included:boolean>")
    nodes = nested.objects_of(typed, "id", "t", True)
    assert [(r["city"], r["fields"]["finances"]) for r in nested.documents_table(nodes).collect()] == [("К", '{"total_rub":5.0,"vat_included":true}')]
    assert [(r["node_path"], r["role"], r["stated_role"]) for r in nested.parties_table(nodes).collect()] == [("party_one", "party_one", "Поставщик")]


# -- scoring and audit


def scored(spark, pred, truth, kind):
    df = spark.createDataFrame([(pred, truth)], "p string, t string")
    score, state = scoring.field_score(F.col("p"), F.col("t"), kind)
    return tuple(df.select(score, state).first())


def test_field_scores(spark):
    assert scored(spark, "240000", "240000", "money") == (100.0, "scored")
    assert scored(spark, "1 234,56", "1234.56", "numeric") == (100.0, "scored")
    assert scored(spark, "7707083893", "7707083893", "inn") == (100.0, "scored")
    assert scored(spark, "7707083890", "7707083890", "inn") == (50.0, "scored")
    assert scored(spark, "7707083890", "7707083893", "inn") == (0.0, "scored")
    assert scored(spark, "15.01.2023", "2023-01-15", "date") == (100.0, "scored")
    assert scored(spark, None, "none", "text") == (None, "absent_both")
    assert scored(spark, None, "x", "text") == (0.0, "missed")
    assert scored(spark, "x", "", "text") == (0.0, "hallucination")


def test_record_scores(spark):
    df = spark.createDataFrame([(1, "240000", "2400000", "a", "a"), (2, "5", "5", "made", None), (3, "5", "5", "b", "b"), (4, None, None, None, None)], "id long, total string, t_total string, n string, t_n string")
    out = {r["id"]: r for r in scoring.record_scores(df, ["id"], {"total": (F.col("total"), F.col("t_total"), "money", 3.0), "n": (F.col("n"), F.col("t_n"), "exact", 1.0)}).collect()}
    assert out[1]["overall"] < 50 and not out[1]["passed"]
    assert out[2]["made_up"] == ["n"] and not out[2]["passed"]
    assert out[3]["overall"] == 100.0 and out[3]["passed"] and out[3]["status"] == "excellent"
    assert out[4]["overall"] == 0.0 and out[4]["truth_weight"] == 0.0


def test_truth_of_equal_keys_is_the_last(spark):
    pred = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    truth = spark.createDataFrame([("a", 10, 1), ("a", 20, 2)], "k string, v int, _seq int")
    assert rows(scoring.with_truth(pred, truth, "k").select("k", "t_v", "mode")) == [("a", 20, "benchmark"), ("b", None, "autonomous_no_ground_truth_match")]


def test_audit_ladder(spark):
    spec = audit.Spec(identifiers=[{"path": "inn", "kind": "inn"}], money=[{"code": "SUM", "total": "total", "parts": ["a", "b"]}], chronology=[{"before": "d1", "after": "d2", "code": "ORDER"}])
    df = spark.createDataFrame([
        (1, "7707083893", 1070.0, 1000.0, 70.0, "01.01.2020", "02.01.2020"), (2, "7707083890", None, None, None, None, None), (3, None, 1200.0, 1000.0, 70.0, "03.01.2020", "02.01.2020"),
        (4, "123", None, None, None, "", ""), (5, None, 5e7, 3e7, 2e7, None, None), (6, None, None, None, None, None, None),
    ], "id int, inn string, total double, a double, b double, d1 string, d2 string")
    out = {r["id"]: (r["verdict"], [i["code"] for i in r["issues"]]) for r in audit.audited(df, spec).collect()}
    assert out == {1: ("verified", []), 2: ("discrepancy", ["INN_CHECKSUM"]), 3: ("discrepancy", ["SUM", "ORDER"]), 4: ("unverified", ["IDENTIFIER_CUT"]), 5: ("partially_verified", []), 6: ("unverified", [])}
    assert spec.problems(df.schema) == []
    bad = audit.Spec(identifiers=[{"path": "zzz", "kind": "odd", "severity": "loud"}], money=[{"code": "M", "total": "total", "parts": ["a"], "min_parts": 2}])
    assert len(bad.problems(df.schema)) == 4


def test_specs_fit_their_tables(spark, tiny):
    for name, spec in audit.SPECS.items():
        assert spec.problems(spark.read.parquet(f"{tiny}/{name}.parquet").schema) == []


# -- registries


def test_merge_replaces_by_identity_and_keeps_the_rest(spark):
    schema = "file_path string, file_name string, doc_type string, v int, seq int"
    old = spark.createDataFrame([("p", "a", "t", 1, 1), ("p", "b", "t", 2, 1), (None, "c", "t", 3, 1)], schema)
    new = spark.createDataFrame([("p", "b", "t", 20, 0), ("q", "b", "t", 5, 0), ("p", "a", "u", 6, 0), (None, "c", "t", 30, 0), (None, "c", "t", 31, 1)], schema)
    got = rows(registry.merged(old, new, ["file_path", "file_name", "doc_type"], "seq").select("file_path", "file_name", "doc_type", "v"))
    assert got == sorted([("p", "a", "t", 1), ("p", "b", "t", 20), (None, "c", "t", 31), ("q", "b", "t", 5), ("p", "a", "u", 6)], key=repr)
    assert rows(registry.merged(old, new.limit(0), ["file_path", "file_name", "doc_type"], "seq")) == rows(old)


def test_resume_names_cache_history(spark):
    todo = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    assert rows(registry.remaining(todo, spark.createDataFrame([("a",), (None,)], "k string"), "k")) == [("b",), (None,)]
    named = spark.createDataFrame([("s", "1"), ("s", "2"), ("s", "1"), ("t", "9")], "stem string, path string")
    assert rows(registry.numbered_names(named, "stem", "path").select("path", "save_as")) == [("1", "s"), ("1", "s"), ("2", "s__2"), ("9", "t")]
    hits, misses = registry.cache_split(todo, spark.createDataFrame([("a", "x")], "k string, v string"), "k")
    assert rows(hits) == [("a", "x")] and rows(misses) == [("b",), (None,)]
    assert rows(registry.newest(spark.createDataFrame([(1, 5), (2, 9), (3, 9)], "id int, t int"), 2, "t", "id")) == [(2, 9), (3, 9)]
    full, legacy = spark.createDataFrame([("a", 1)], "stem string, v int"), spark.createDataFrame([("a", 2), ("b", 3)], "stem string, v int")
    assert rows(registry.canonical(full, legacy, "stem")) == [("a", 1), ("b", 3)]
    st = spark.createDataFrame([("OK", None), ("FAILED", False), (None, True), (None, False)], "status string, extraction_failed boolean")
    assert rows(registry.exportable(st)) == [("OK", None), (None, False)]


# -- routing and summaries


def test_routing_order(spark):
    df = spark.createDataFrame([("x/invoices_upd/удержание.pdf", ""), ("УПД 5.pdf", ""), ("упдейт.pdf", "ПРЕТЕНЗИЯ к оплате"), ("z", None)], "p string, t string")
    got = [tuple(r["r"]) for r in df.select(routing.routed(F.col("p"), F.col("t")).alias("r")).collect()]
    assert got == [("invoices_upd", 0.95, "heuristic_path"), ("invoices_upd", 0.9, "heuristic_keyword"), ("legal_claims", 0.92, "text_content_marker"), ("unknown", 0.0, "unknown")]


def test_summaries(spark):
    df = spark.createDataFrame([("a", 0.0, 5.0, True), ("a", 3.0, 9.0, False), ("b", None, None, None)], "doc_type string, x double, y double, ok boolean")
    assert rows(rollup.money_summary(df, [F.col("x"), F.col("y")], F.col("ok"))) == sorted([("a", 2, 1, 8.0), ("b", 1, 0, 0.0), (None, 3, 1, 8.0)], key=repr)
    codes = spark.createDataFrame([(0,), (3,), (1,)], "c int")
    assert rollup.exit_code(codes, F.col("c")).first()[0] == 1
    assert rollup.exit_code(codes.where("c <> 1"), F.col("c")).first()[0] == 3
    assert rollup.exit_code(codes.limit(0), F.col("c")).first()[0] == 1


def test_flat_rows(spark):
    df = spark.createDataFrame([(1, "5.6.2020", None, ("nan", 12.5)), (2, None, " x ", None)], "id int, doc_date string, n string, f struct<t:string,a:double>")
    out = flat.flat(df, ["id"], {"Date": ("date", "doc_date"), "N": ("text", "f.t|n"), "A": ("number", "f.a"), "Z": ("text", "zz")}, {"Code": F.lit(10)})
    assert rows(out) == [(1, "2020-06-05", "", 12.5, "", 10), (2, "", "x", 0.0, "", 10)]


# -- guardrails, formats, recovery


def test_guardrails(spark):
    df = spark.createDataFrame([(1, "5", "01.02.2020", "50%", "7707083893", "10701/16/3001-ИП"), (2, " ", "31.02.2020", "150%", "7707083890", ""), (3, None, None, None, None, None)], "id int, a string, d string, p string, inn string, ip string")
    rules = [("a", "not_empty"), ("a", "positive_number"), ("d", "date_format"), ("p", "valid_percentage"), ("inn", "valid_inn"), ("ip", "ip_number_format_optional"), ("zz.y", "required"), ("a", "odd")]
    odd = []
    out = {r["id"]: (r["rules_passed"], r["rules_total"], r["failed_rules"]) for r in guardrails.guarded(df, rules, odd.append).collect()}
    assert odd == ["odd"]
    assert out[1] == (6, 7, ["zz.y:required"]) and out[2][0] == 1 and out[3][0] == 1
    assert not guardrails.guarded(df, []).first()["guard_passed"] and guardrails.guarded(df, []).first()["rule_score"] == 0.0


def test_format_scores(spark):
    df = spark.createDataFrame([("А40-1234/2021", "2021-03-15", "ИНН 7707083893"), ("1234567", "15 марта 2021", "ИНН 7707083890"), ("?!", "сумма", "без номера"), (None, "", None)], "c string, d string, i string")
    got = [tuple(r) for r in df.select(guardrails.case_number_score(F.col("c")), guardrails.date_score(F.col("d")), guardrails.inn_in_text_score(F.col("i"))).collect()]
    assert got == [(100.0, 100.0, 100.0), (60.0, 95.0, 0.0), (40.0, 20.0, 50.0), (0.0, 0.0, 0.0)]
    b = spark.createDataFrame([(1070.0, 1000.0, 70.0), (1070.5, 1000.0, 70.0), (2000.0, 1000.0, None), (5.0, None, None), (None, 1.0, None), (None, None, None)], "t double, a double, b double")
    assert [r[0] for r in b.select(guardrails.balance_score(F.col("t"), F.col("a"), F.col("b"))).collect()] == [100.0, 90.0, 50.0, 95.0, 90.0, 100.0]


def test_recovery_fills_only_where_all_totals_are_blank(spark):
    text = "Взыскать основной долг 250 000 руб., пени 15 000 руб."
    df = spark.createDataFrame([(1, text, None, 0.0), (2, text, 5.0, None), (3, None, None, None), (4, "", None, 7.0)], "id int, t string, total double, debt double")
    out = {r["id"]: (r["total"], r["debt"], r["recovered"]) for r in recovery.recovered(df, "t", ["total"], {"total": ("total_rub", None), "debt": ("main_debt_rub", None)}).collect()}
    assert out == {1: (265000.0, 250000.0, ["total", "debt"]), 2: (5.0, None, []), 3: (None, None, []), 4: (None, 7.0, [])}


def test_states(spark):
    df = spark.createDataFrame([("FAILED", "verified", False, "ocr"), ("OK", "discrepancy", True, "vlm_transcription"), (None, None, False, None)], "s string, v string, e boolean, p string")
    got = [tuple(r) for r in df.select(recovery.needs_review(F.col("s"), F.col("v"), ["discrepancy"]), recovery.document_status(F.coalesce(F.col("s") == "FAILED", F.lit(False)), F.col("e")), recovery.provenance(F.col("p"))).collect()]
    assert got == [(True, "FAILED", "independent"), (True, "NEEDS_REVIEW", "dependent"), (False, "COMPLETED", "none")]
    q = df.select(recovery.combined_quality(F.lit(96.0), F.col("e"), F.lit(True), F.lit(5)).alias("q")).collect()
    assert [tuple(r["q"]) for r in q] == [(71.0, "satisfactory"), (71.0, "needs_attention"), (71.0, "satisfactory")]


def test_verdict_columns_and_unwrapping(spark):
    df = spark.createDataFrame([(1, (5, "in"), "out", "verified"), (2, (6, None), "out", "discrepancy"), (3, None, None, None)], "id int, data struct<a:int,b:string>, b string, verdict string")
    got = [tuple(r) for r in flat.with_verdict(df, F.col("verdict"), F.col("verdict") == "discrepancy", ["partially_verified"]).select("Verdict", "VerdictValid", "RequiresHumanReview", "AdvisoryReview").collect()]
    assert got == [("verified", True, False, False), ("discrepancy", False, True, False), ("", None, True, False)]
    assert flat.unwrapped(df, "data", ["b", "id"]).columns == ["a", "b", "id"]


def test_specs_of_types_without_a_table(spark):
    rows = spark.createDataFrame(
        [("1", "01.02.2023", ("1000", "200", "1200"), ("7707083893", "Альфа"), ("7707083894", "Бета"), "02.02.2023"), ("2", "01.02.2023", ("1000", "200", "1300"), ("7707083893", "Альфа"), (None, None), "31.31.2023")],
        "doc_number string, doc_date string, finances struct<amount_no_vat_rub:string,vat_amount_rub:string,total_rub:string>, contractor struct<inn:string,name:string>, customer struct<inn:string,name:string>, contract_date string",
    )
    spec = audit.MORE_SPECS["acceptance_certificates"]
    assert spec.problems(rows.schema) == []
    got = audit.audited(rows, spec).orderBy("doc_number").select("verdict", "issues").collect()
    assert [{i["code"] for i in r["issues"]} for r in got] == [{"INN_CHECKSUM", "CHRONO_CONTRACT_BEFORE_ACT"}, {"ACCEPTANCE_MATH_DISCREPANCY", "UNPARSEABLE_DATE"}]
    assert [r["verdict"] for r in got] == ["discrepancy", "discrepancy"]
    assert set(audit.MORE_SPECS) == {"hr_orders", "powers_of_attorney", "acceptance_certificates"}
    assert audit.Spec(bank={"iban": "x"}).problems(rows.schema) == ["unknown bank details ['iban']"]


def test_a_suite_keeps_extraction_apart_from_the_truth_itself(spark):
    truth = spark.createDataFrame([("a.pdf", "t", "X", 100.0), ("b.pdf", "t", "Y", 5.0), ("c.pdf", "u", "Z", 7.0), ("d.pdf", "u", None, None)], "file_name string, doc_type string, n string, total double")
    results = spark.createDataFrame([("a", "p1", "other", 1.0), ("a_Full", "p2", "X", 100.0), ("b_t", "p3", "Y", 50.0), ("c_t", "p4", "Z", 7.0)], "saved_as string, path string, n string, total double")
    out = scoring.suite(truth, results, {"n": ("n", "exact", 1.0), "total": ("total", "numeric", 1.0)})
    assert {r["file_name"]: (r["extracted"], r["overall"]) for r in out.collect()} == {"a.pdf": (True, 100.0), "b.pdf": (True, 50.0), "c.pdf": (False, 100.0), "d.pdf": (False, 0.0)}
    got = {r["doc_type"]: tuple(r)[1:] for r in scoring.suite_averages(out).collect()}
    assert got == {"t": (2, 2, 75.0, 0.0), "u": (2, 0, 0.0, 50.0), None: (4, 2, 75.0, 50.0)}
    assert scoring.suite(truth.limit(0), results, {"n": ("n", "exact", 1.0)}).count() == 0


def test_noise_is_repeatable_and_grows_with_its_rate(spark, tiny):
    body = "Взыскать 1500 рублей с ООО Ромашка " * 20
    assert measure.misread(body, 0.1, 5) == measure.misread(body, 0.1, 5) != measure.misread(body, 0.1, 6)
    assert measure.misread(body, 0.0, 5) == body and measure.misread("", 0.5, 1) == "" and measure.misread("—!", 1.0, 1) == "—!"
    from paperloom.plans import core_queries

    curve = {r["rate"]: r for r in core_queries.q_gate_curve(spark, tiny).collect()}
    assert curve[0.0]["false_positive_percent"] == 0.0
    shares = [curve[r]["false_positive_percent"] for r in sorted(curve)]
    assert shares == sorted(shares) and shares[-1] > 50


def test_verdicts_are_found_in_every_form(spark):
    df = spark.createDataFrame([("", ("verified",)), ("discrepancy", (None,)), (None, None)], "zero_trust_status string, zero_trust struct<status:string>")
    assert [r[0] for r in df.select(flat.status_of(df)).collect()] == ["verified", "discrepancy", ""]
    assert spark.range(1).select(flat.status_of(spark.range(1))).first()[0] == ""


def test_running_totals_by_cells_are_those_of_one_window(spark):
    rows = [("a" if i % 3 else "b", i, None if i < 4 or i % 7 == 0 else i) for i in range(60)] + [(None, 1, 5), (None, 2, 6), ("c", None, 1)]
    df = spark.createDataFrame(rows, "k string, t int, v int")
    out = [sorted(map(repr, rollup.running(df, "k", ["t"], F.col("v"), cell).collect())) for cell in (None, F.floor(F.col("t") / 5), F.lit(1))]
    assert out[0] == out[1] == out[2] and len(out[0]) == len(rows)
