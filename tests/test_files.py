"""Sources, sinks, block repair, scoring, streams, SQL functions, service and command line."""

import io
import json
import threading
import urllib.error
import urllib.request
import zipfile

import pytest
from pyspark.sql import functions as F

from inkveil import __main__ as cli
from inkveil import service
from inkveil.functions import tables
from inkveil.operators import engine, scoring
from inkveil.settings import Settings
from inkveil.sources import blocks, docx, files
from inkveil.streaming import redact as streaming

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" xmlns:w14="http://schemas.microsoft.com/office/word/2010/wordml" mc:Ignorable="w14"'


def _run(text, bold=False):
    return f'<w:r>{"<w:rPr><w:b/></w:rPr>" if bold else ""}<w:t xml:space="preserve">{text}</w:t></w:r>'


def _package():
    body = f'<w:document {NS}><w:body><w:tbl><w:tr><w:tc><w:p>{_run("cell jane.roe@example.org")}</w:p></w:tc></w:tr></w:tbl><w:p>{_run("mail jane")}<w:hyperlink>{_run(".roe@exam", True)}</w:hyperlink>{_run("ple.org now")}</w:p><w:sectPr><w:headerReference w:type="default" r:id="h1"/></w:sectPr></w:body></w:document>'
    parts = {"word/document.xml": body, "word/header1.xml": f"<w:hdr {NS}><w:p>{_run('head')}</w:p></w:hdr>", "word/_rels/document.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="h1" Type="x" Target="header1.xml"/></Relationships>'}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return out.getvalue()


def test_docx_round_trip():
    data = _package()
    assert docx.texts(data) == ["mail jane.roe@example.org now", "cell jane.roe@example.org", "head"]
    new = docx.rewrite(data, {0: [(5, 25, "X"), (26, 29, "then")]})
    assert docx.texts(new) == ["mail X then", "cell jane.roe@example.org", "head"]
    xml = zipfile.ZipFile(io.BytesIO(new)).read("word/document.xml").decode()
    assert "<w:b />" in xml and "xmlns:w14=" in xml
    assert docx.texts(docx.from_blocks(["a\nb", ""])) == ["a\nb", ""]


@pytest.mark.parametrize(
    "old,new",
    [(["Email:\njane@acme.co", "m Telephone: + 91 20", "45053237"], ["Email:\njane@acme.com Telephone: + 91 20 45053237"]), (["One.", "Two."], ["One.", "Two."]), (["a -", "B"], ["a - B"]), (["x\u200by\u00a0 z", None], ["xy z"]), (["see www.acme-\nfoods. com"], ["see www.acme-foods.com"]), ([], [])],
)
def test_repair(spark, old, new):
    assert spark.createDataFrame([(old,)], "b array<string>").select(blocks.merge(F.col("b")).alias("m")).first().m == new


def test_files_and_reports(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.docx").write_bytes(_package())
    (tmp_path / "in/b.TXT").write_bytes(b"write to jane.roe@example.org\n\n\n\n  call +91 22 4505 4321 today\xff")
    (tmp_path / "in/empty.md").write_text("")
    with pytest.raises(ValueError):
        files.kind_of("x.csv")
    paths = [str(tmp_path / "in" / n) for n in ("a.docx", "b.TXT", "empty.md")]
    assert cli.main(["redact", *paths, "-o", str(tmp_path / "out"), "--report", str(tmp_path / "rep"), "--no-mapping"]) == 0
    text = (tmp_path / "out/b.TXT").read_text()
    assert "jane.roe" not in text and "4505 4321" not in text and len(text.split("\n\n")) == 2
    body = docx.texts((tmp_path / "out/a.docx").read_bytes())
    assert not any("jane.roe" in t for t in body) and body[2] == "head" and body[0].startswith("mail ")
    assert body[0].split()[1] == body[1].split()[1]
    s = json.loads(spark.read.text(str(tmp_path / "rep/summary.json")).first().value)
    assert s["by_type"] == {"EMAIL": 3, "PHONE": 1} and not (tmp_path / "rep/mapping.json").exists()
    assert spark.read.csv(str(tmp_path / "rep/entities.csv"), header=True).count() == 4


def test_straddling_spans():
    e, m = [{"type": "PHONE", "start": 2, "end": 8, "text": "bc\n\nde"}], [{"type": "PHONE", "original": "bc\n\nde", "surrogate": "9"}]
    assert files.render("txt", None, ["a bc", "de"], e, m, "drop") == (b"a bc\n\nde", 1)
    assert files.render("txt", None, ["a bc", "de"], e, m, "clip") == (b"a 9\n\nde", 0)


def test_scores(spark):
    rec = "id string, stratum string, text string, labels array<struct<type:string,text:string,occurrence:int>>"
    gold = scoring.locate(spark.createDataFrame([("1", "s", "Al (x) met Al\n Bo", [("PERSON", "Al Bo", None), ("URL", "(x)", 1)]), ("2", "s", "none", [])], rec))
    rows = {r.id: [(e.type, e.start, e.end) for e in r.entities] for r in gold.collect()}
    assert rows == {"1": [("URL", 3, 6), ("PERSON", 11, 17)], "2": []}
    pred = spark.createDataFrame([("1", [("PERSON", 15, 17), ("PERSON", 11, 17), ("URL", 3, 5)]), ("2", [("URL", 0, 4)])], "id string, entities array<struct<type:string,start:int,end:int>>")
    part = {r.type: (r.tp, r.fp, r.fn) for r in scoring.scores(gold, pred).collect()}
    assert part == {"PERSON": (1, 1, 0), "URL": (1, 1, 0), None: (2, 2, 0)}
    assert {r.type: (r.tp, r.fp, r.fn) for r in scoring.scores(gold, pred, partial=False).collect()} == {"PERSON": (1, 1, 0), "URL": (0, 2, 1), None: (1, 3, 1)}
    t = scoring.token_scores(gold, pred).first()
    assert (t.tp, t.fp, t.fn, t.tn, t.accuracy) == (3, 1, 0, 2, 0.8333)
    with pytest.raises(Exception, match="label not found"):
        scoring.locate(spark.createDataFrame([("1", "s", "abc", [("URL", "x", None)])], rec)).collect()


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(1, "mail jane.roe@example.org"), (2, None)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    streaming.run(spark, str(tmp_path / "in"), "doc_id long, text string", str(tmp_path / "out"), once=True).awaitTermination(120)
    got = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r.doc_id: r.redacted for r in engine.detect(docs).collect()} and "jane.roe" not in got[1]


def test_sql_functions(spark):
    tables.register(spark)
    rows = spark.sql("SELECT t.id, e.type, e.text, redact_text(t.text) AS safe FROM VALUES (1, 'mail jane.roe@example.org'), (2, NULL) t(id, text), LATERAL find_entities(t.text) e").collect()
    assert [(r.id, r.type, r.text) for r in rows] == [(1, "EMAIL", "jane.roe@example.org")] and "jane.roe" not in rows[0].safe


def test_service():
    server = service.serve(port=0, settings=Settings())
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"

    def post(path, data, **headers):
        return urllib.request.urlopen(urllib.request.Request(base + path, data, {k.replace("_", "-"): v for k, v in headers.items()}))

    try:
        assert json.load(urllib.request.urlopen(base + "/health"))["status"] == "ok"
        ask = json.dumps({"text": "mail jane.roe@example.org", "types": ["email"]}).encode()
        assert json.load(post("/analyze", ask))["counts"] == {"EMAIL": 1}
        assert "jane.roe" not in json.load(post("/redact/text", ask))["text"]
        answer = post("/redact", _package(), X_File_Name="a.docx")
        assert answer.headers["X-PII-Entities-Redacted"] == "2" and "jane.roe" not in "".join(docx.texts(answer.read()))
        for path, data, headers, code in (("/redact", b"x", {"X_File_Name": "a.csv"}, 415), ("/analyze", b"{}", {}, 422), ("/none", b"", {}, 404)):
            with pytest.raises(urllib.error.HTTPError) as e:
                post(path, data, **headers)
            assert e.value.code == code
    finally:
        server.shutdown()


def test_gold_of_paragraphs_and_examples(spark, tmp_path):
    from inkveil.__main__ import main
    from inkveil.operators import engine, scoring, spans

    texts = ["Mr. Rohan Mehta came.", "write to jane.roe@example.org", "nothing here"]
    records = [{"index": 0, "anchor": "Mr. Rohan", "stratum": "a", "entities": [{"type": "PERSON", "text": "Rohan  Mehta"}]}, {"index": 1, "anchor": "write", "stratum": "a", "entities": [{"type": "EMAIL", "text": "jane.roe@example.org"}, {"type": "PERSON", "text": "write"}]}, {"index": 2, "anchor": "", "stratum": "b", "entities": []}]
    (tmp_path / "gold.json").write_text(json.dumps({"records": records}))
    read = scoring.read_labels(spark, str(tmp_path / "gold.json"))
    segments = spark.createDataFrame(list(enumerate(texts)), "index int, text string")
    gold = scoring.locate(scoring.with_paragraphs(read, segments))
    assert {r.id: [e.text for e in r.entities] for r in gold.collect()} == {"0": ["Rohan Mehta"], "1": ["write", "jane.roe@example.org"], "2": []}
    for bad in (segments.where("index < 2"), segments.withColumn("text", F.upper("text"))):
        with pytest.raises(Exception, match="record"):
            scoring.with_paragraphs(read, bad).collect()
    whole = "\n\n".join(texts)
    found = [(s[0], s[1], s[2]) for s in engine.analyze(whole, Settings())]
    starts = spans.segment_starts(segments.withColumn("doc", F.lit(0)), "doc", "index")
    pred = scoring.of_paragraphs(spark.createDataFrame(found, "type string, start int, end int"), read, starts)
    by = {r.id: [(e.type, e.start, e.end) for e in r.entities] for r in pred.collect()}
    assert by == {"0": [("PERSON", 4, 15)], "1": [("EMAIL", 9, 29)], "2": []}
    with_text = engine.detect(gold.select("id", "text")).select("id", "entities")
    assert {r.type: (r.missed, r.spurious) for r in scoring.examples(gold, with_text).collect()} == {"PERSON": (["write"], [])}
    (tmp_path / "own.json").write_text(json.dumps({"records": [{"id": "x", "stratum": "a", "text": texts[1], "entities": [{"type": "EMAIL", "text": "jane.roe@example.org"}]}]}))
    assert main(["evaluate", str(tmp_path / "own.json"), "-o", str(tmp_path / "results.json")]) == 0
    out = json.loads((tmp_path / "results.json").read_text())
    assert out["suites"]["own.json"]["strict"][0]["tp"] == 1 and "types" in out["config"]


def test_counts_by_recognizer(spark):
    from inkveil.operators import engine

    found = engine.detect(spark.createDataFrame([("a@b.com a@b.com c@d.org +91 20 45053237",)], "text string"))
    assert sorted(map(tuple, engine.by_recognizer(found).collect())) == [("EMAIL", "email", 3, 2, 0.75), ("PHONE", "phone", 1, 1, 0.25)]


def test_form_and_multipart():
    from inkveil import service

    server = service.serve(port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"
    try:
        page = urllib.request.urlopen(base + "/")
        assert b"<form" in page.read() and page.headers["Content-Type"].startswith("text/html")
        body = b'--xx\r\nContent-Disposition: form-data; name="seed"\r\n\r\nabc\r\n--xx\r\nContent-Disposition: form-data; name="file"; filename="a.txt"\r\nContent-Type: text/plain\r\n\r\nmail jane.roe@example.org\r\n--xx--\r\n'
        ask = lambda b: urllib.request.urlopen(urllib.request.Request(base + "/redact", b, {"Content-Type": "multipart/form-data; boundary=xx"}))
        got = ask(body)
        assert b"jane.roe" not in got.read() and got.headers["X-PII-Entities-Redacted"] == "1"
        for bad, status in ((body.replace(b'name="file"', b'name="other"'), 422), (body.replace(b"a.txt", b"a.exe"), 415)):
            with pytest.raises(urllib.error.HTTPError) as e:
                ask(bad)
            assert e.value.code == status
    finally:
        server.shutdown()


def test_command_line_flags():
    from inkveil.__main__ import parser

    a = parser().parse_args(["redact", "x.txt", "-o", "out", "--no-propagation", "--redact-public", "-v"])
    assert a.no_propagation and a.redact_public and a.verbose
