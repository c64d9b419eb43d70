from test_extract import A, B

from voltledger.operators import glossary, rules
from voltledger.plans import flows
from voltledger.sources import documents, stores, workbook
from voltledger.sources.documents import Job
from voltledger.streaming import ingest


def folders(tmp_path):
    (tmp_path / "a" / "sub").mkdir(parents=True)
    (tmp_path / "b").mkdir()
    (tmp_path / "a" / "2024000000001.PDF").write_text(A)
    (tmp_path / "a" / "sub" / "2024000000001.pdf").write_text(A + "copy")
    (tmp_path / "a" / "sub" / "2024000000002.pdf").write_text("ENDEREÇO DE ENTREGA: sem itens R$***10,00" + " " * 100 + "x" * 100)
    (tmp_path / "a" / "sub" / "bad.pdf").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "b" / "c.pdf").write_text(B)
    return [Job(str(tmp_path / "a"), "EQUATORIAL", True), Job(str(tmp_path / "b"), "CHESP")]


def test_folders_to_sheets_and_back(spark, tmp_path):
    jobs = folders(tmp_path)
    assert documents.count(spark, jobs) == 5
    done = flows.process_folders(spark, jobs, user_rules=stores.load_rules(tmp_path / "rules.json"))
    ids = sorted(r.id_fatura for r in done.sheets["fatura"].collect())
    assert ids == ["CHESP_96411", "EQUATORIAL_2024000000001"]
    assert {r.error.split(":")[0] for r in done.errors.collect()} == {"total without items", "UnicodeDecodeError"}
    assert list(done.sheets) == ["fatura_resumida", "fatura", "unidade_consumidora", "itens_fatura", "impostos", "medicao", "medicao_resumida"]
    assert done.sheets["medicao_resumida"].first()["energia_geracao_kwh"] == 7.0
    assert all(r.medidor for r in done.sheets["fatura"].collect())
    report = flows.reconcile_workbook(done.sheets)
    assert report["Resumo"].count() == 2 and report["Total_divergencias"].count() == 2

    tables = glossary.with_glossary(done.sheets, glossary.glossary(spark))
    workbook.write_folder(tables, str(tmp_path / "out"), {"k": 1})
    back, meta = workbook.read_folder(spark, str(tmp_path / "out"))
    assert meta == {"k": 1} and list(back) == list(tables) and back["itens_fatura"].count() == done.sheets["itens_fatura"].count()
    workbook.write_xlsx(tables, str(tmp_path / "out.xlsx"), {"k": 2})
    cells, meta = workbook.read_xlsx(spark, str(tmp_path / "out.xlsx"))
    assert meta == {"k": 2} and cells["fatura"].columns == tables["fatura"].columns and cells["impostos"].count() == tables["impostos"].count()

    again = flows.append_to(back, None, {k: v for k, v in done.sheets.items()})[0]
    for name in ("fatura", "itens_fatura", "impostos", "medicao"):
        assert again[name].count() == back[name].distinct().count(), name  # equal rows become one
    flows.apply_rules_to_file(spark, str(tmp_path / "out"), str(tmp_path / "out2"), stores.load_rules(tmp_path / "rules.json"))


def test_workbook_files_with_rules_and_reports(spark, tmp_path):
    import zipfile

    jobs = folders(tmp_path)
    done = flows.process_folders(spark, jobs)
    assert {r.counter: r.n for r in done.counters().collect()} == {"total": 5, "processed": 2, "errors": 2}
    source, target, report = (str(tmp_path / n) for n in ("a.xlsx", "b.xlsx", "report.xlsx"))
    workbook.write_xlsx(done.sheets, source, {"k": 3}, widest=30)
    with zipfile.ZipFile(source) as z:
        assert 'customWidth="1"' in z.read("xl/worksheets/sheet1.xml").decode()
    widths = workbook.widths(done.sheets["fatura"].select("id_fatura", "cfop"))
    assert widths == {"id_fatura": 24, "cfop": 4}
    lines = flows.apply_rules_to_file(spark, source, target, rules.parse([{"nome": "r", "aba": "impostos", "grupos": [{"operador": "E", "condicoes": [{"coluna": "Tributo", "operador": "igual", "valor": "ICMS"}]}], "acoes": [{"coluna": "Tributo", "valor": "none"}]}]))
    back, meta = workbook.read_xlsx(spark, target)
    n = done.sheets["impostos"].where("Tributo = 'ICMS'").count()
    assert meta == {"k": 3} and back["impostos"].where("Tributo = 'none'").count() == n == lines[0].rows.first().rows
    flows.write_report(done.sheets, report)
    found, _ = workbook.read_xlsx(spark, report)
    assert set(found) == {"Resumo", "Impostos_divergencias", "Total_divergencias"}
    gaps = [abs(float(r.diferenca)) for r in found["Total_divergencias"].collect()]
    assert gaps == sorted(gaps, reverse=True)


def test_decoders_and_recognition_are_hooks(spark, tmp_path):
    """Any decoder may be given: here pages come from a made-up format, and recognition runs only where there is too little text."""
    (tmp_path / "in").mkdir()
    long = "ENDEREÇO DE ENTREGA: " + "x" * 120
    (tmp_path / "in" / "a.pdf").write_bytes(b"advert|" + long.encode())
    (tmp_path / "in" / "b.pdf").write_bytes(b"scan|")
    (tmp_path / "in" / "c.pdf").write_bytes(b"broken")

    def decode(content):
        if content == b"broken":
            raise ValueError("no pages")
        return content.decode().split("|")

    good, bad = documents.texts(spark, [Job(str(tmp_path / "in"), "EQUATORIAL")], decode, lambda content: ["read from the image " * 10])
    got = {r.path.rsplit("/", 1)[1]: r.text for r in good.collect()}
    assert got == {"a.pdf": long, "b.pdf": "read from the image " * 10}
    assert [(r.path.rsplit("/", 1)[1], r.error) for r in bad.collect()] == [("c.pdf", "ValueError: no pages")]


def test_invoices_without_a_meter_keep_their_unit(spark):
    from voltledger.operators import derive

    bills = spark.createDataFrame([(str(i), f"{i}.0-1") for i in range(50)], "id_fatura string, id_uc string")
    read = spark.createDataFrame([("3", "3.0-1", "m", "2024-01"), ("4", "9.0-1", "m", "2024-02")], "id_fatura string, id_uc string, Medidor string, competencia string")
    got = {r.id_fatura: (r.medidor, r.id_uc_atual) for r in derive.with_meters({"fatura": bills, "medicao": read})["fatura"].collect()}
    assert got == {str(i): (None, f"{i}01") for i in range(50) if i not in (3, 4)} | {"3": ("m", "901"), "4": ("m", "901")}


def test_stores(spark, tmp_path):
    assert [(r["id"], r["ativo"]) for r in stores.DEFAULT_RULES][0] == ("hc_consumo_kwh_para_consumo", True)
    stores.save_equivalences([("a", "X"), ("A ", "Y"), (" ", "Z"), ("b", "")], tmp_path / "e.json")
    assert [tuple(r) for r in stores.load_equivalences(spark, tmp_path / "e.json").collect()] == [(0, "a", "X"), (1, "b", "")]
    assert stores.load_equivalences(spark, tmp_path / "none.json").isEmpty()


def test_workbook_rows_are_parsed_on_the_executors(spark, tmp_path):
    import zipfile

    table = spark.createDataFrame([(i, None if i % 3 == 0 else f"<é{i}>") for i in range(9000)], "id int, `a b` string").coalesce(1)
    for name in ("x", "y"):
        workbook.write_xlsx({"t": table, "none": table.limit(0)}, str(tmp_path / f"{name}.xlsx"), {"k": name})
    rows = workbook.xlsx_rows(spark, str(tmp_path / "*.xlsx"), only="t")
    assert {(r.n, r.m) for r in rows.groupBy("path").agg({"n": "count", "*": "count"}).toDF("path", "n", "m").collect()} == {(9001, 9001)}
    back, meta = workbook.read_xlsx(spark, str(tmp_path / "x.xlsx"))
    assert meta == {"k": "x"} and back["none"].count() == 0 and [tuple(r) for r in back["t"].collect()] == [(str(i), None if i % 3 == 0 else f"<é{i}>") for i in range(9000)]
    shared = str(tmp_path / "shared.xlsx")
    with zipfile.ZipFile(str(tmp_path / "x.xlsx")) as old, zipfile.ZipFile(shared, "w") as new:
        for n in old.namelist():
            body = old.read(n)
            if n == "xl/worksheets/sheet1.xml":
                body = b'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="2"><c r="C2"><v>5</v></c></row><row r="3"/></sheetData></worksheet>'
            new.writestr(n, body)
        new.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>one</t></si><si><r><t>tw</t></r><r><t>o</t></r></si></sst>')
    t = workbook.read_xlsx(spark, shared)[0]["t"]
    assert t.columns == ["one", "None", "two"] and [tuple(r) for r in t.collect()] == [(None, None, "5"), (None, None, None)]


def test_glossary_is_added_once(spark):
    table = glossary.glossary(spark, [("CONSUMO", "Energy used.")])
    assert glossary.with_glossary({"Glossário": table}, table).keys() == {"Glossário"}
    assert table.where("`Categoria` = 'Item de fatura'").count() == 1


def test_stream_appends_each_invoice_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "2024000000001.txt").write_text(A)
    stream = lambda: ingest.append_stream(ingest.watch(spark, str(tmp_path / "in"), "EQUATORIAL"), "EQUATORIAL", str(tmp_path / "out"), str(tmp_path / "state"))
    stream().awaitTermination(120)
    (tmp_path / "in" / "again-2024000000001.txt").write_text(A.replace("10605788", "2024000000001 10605788"))
    (tmp_path / "in" / "2024000000003.txt").write_text(A)
    stream().awaitTermination(120)
    assert sorted(r.batch for r in spark.read.parquet(str(tmp_path / "out" / "_commits")).collect()) == [0, 1]
    whole = ingest.committed(spark, str(tmp_path / "out"), "fatura").count()
    spark.read.parquet(str(tmp_path / "out" / "fatura" / "batch=0")).write.parquet(str(tmp_path / "out" / "fatura" / "batch=7"))  # of a batch that failed halfway
    assert ingest.committed(spark, str(tmp_path / "out"), "fatura").count() == whole == 2
    ids = [r.id_fatura for r in ingest.committed(spark, str(tmp_path / "out"), "fatura").collect()]
    assert sorted(ids).count("EQUATORIAL_2024000000001") == 1 and "EQUATORIAL_2024000000003" in ids
