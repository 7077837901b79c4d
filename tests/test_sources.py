import io
import os
import time
import zipfile

from leafmill.operators import incremental as inc
from leafmill.sources import documents as src

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(*body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{''.join(body)}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {W}><w:style w:styleId="H2"><w:name w:val="heading 2"/></w:style></w:styles>')
    return out.getvalue()


def p(text, style="", page=False):
    s = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    b = '<w:r><w:br w:type="page"/></w:r>' if page else ""
    return f"<w:p>{s}{b}<w:r><w:t>{text}</w:t></w:r></w:p>"


TABLE = "<w:tbl>" + "".join(f"<w:tr>{''.join(f'<w:tc>{p(c)}</w:tc>' for c in row)}</w:tr>" for row in (("a|b", "c"), ("1", "2"))) + "</w:tbl>"


def write(folder, **files):
    for name, content in files.items():
        (folder / name.replace("__", ".")).write_bytes(content)


def test_documents(spark, tmp_path):
    write(
        tmp_path, a__docx=docx(p("Title", "H2"), p("one"), TABLE, p("two", page=True)), b__docx=b"broken", c__txt=b"x", d__pdf=b"%PDF two pages", e__docx=docx(),
    )
    files = src.load_files(spark, [str(tmp_path)])
    rows = {os.path.basename(r.path): r for r in src.documents(files, read_pdf=lambda b: ["p1", "p2"]).collect()}
    assert rows["a.docx"].pages == ["## Title\none\n\n| a\\|b | c |\n| --- | --- |\n| 1 | 2 |\n", "two"]
    assert rows["b.docx"].error.startswith("BadZipFile") and rows["b.docx"].markdown is None
    assert rows["c.txt"].error == "ValueError: Unsupported format: .txt"
    assert rows["d.pdf"].pages == ["p1", "p2"] and "*Page 2*" in rows["d.pdf"].markdown
    assert rows["e.docx"].pages == [""]


def test_missing_readers_are_rows(spark, tmp_path):
    write(tmp_path, a__odt=b"x")
    row = src.documents(src.load_files(spark, [str(tmp_path)])).first()
    assert row.error and row.pages == []


def test_write_and_read_back(spark, tmp_path):
    write(tmp_path, a__docx=docx(p("text")))
    done = src.documents(src.load_files(spark, [str(tmp_path)]))
    src.write_markdown(done)
    assert (tmp_path / "a.md").read_text().endswith("---\n\ntext")
    found = src.existing_markdown(spark, str(tmp_path))
    again = src.existing_outputs(done, found.selectExpr("replace(path, 'file:///', 'file:/') AS path", "markdown")).first()
    assert again.exists and again.old_markdown == again.markdown


def test_watch_cycles(spark, tmp_path):
    from leafmill.streaming import watch

    folder, taken = tmp_path / "in", []
    folder.mkdir()
    old = time.time() - 3600

    def put(name, content):
        (folder / name).write_bytes(content)
        os.utime(folder / name, (old, old))

    put("a.pdf", b"x" * 200)
    put("b.txt", b"x" * 200)
    put("c.docx", b"x" * 10)
    (folder / "d.pdf").write_bytes(b"x" * 200)
    store = inc.StateStore(spark, f"file://{tmp_path}/state")

    def run(n):
        q = watch.watch(spark, [str(folder), str(tmp_path / "missing")], store, str(tmp_path / "cp"), lambda t: taken.append(sorted(os.path.basename(r.key) for r in t.collect())), minutes=None)
        q.awaitTermination(120)
        assert q.exception() is None

    run(1)
    assert taken == [["a.pdf"]]
    run(2)
    assert taken == [["a.pdf"]]
    put("a.pdf", b"y" * 300)
    put("d.pdf", b"x" * 200)
    run(3)
    assert taken == [["a.pdf"], ["a.pdf", "d.pdf"]]
    reasons = {os.path.basename(r.path): r.reason for r in watch.cycle(spark.createDataFrame([(str(folder / "c.docx"), 10, old)], "path string, length long, mtime double"), store, lambda t: None, time.time()).collect()}
    assert reasons == {"c.docx": "too small"}


def test_online_learning(spark, sf, tmp_path):
    from pyspark.sql import functions as F

    from leafmill.streaming.online import OnlineLearner, decided

    o = spark.read.parquet(f"{sf}/ocr_outcomes.parquet").distinct()
    learner = OnlineLearner(spark, f"file://{tmp_path}/l", f"{tmp_path}/keys/k")
    draws = (F.lit(0.99), F.lit(0.99))
    assert decided(learner, o, draws).where("is_exploration").count() == 0
    o.write.parquet(f"{tmp_path}/stream")
    stream = spark.readStream.schema(o.schema).parquet(f"{tmp_path}/stream")
    learner.start(stream, f"{tmp_path}/cp").awaitTermination(120)
    assert learner.outcomes().count() == o.count() and learner.model is not None
    again = OnlineLearner(spark, f"file://{tmp_path}/l", f"{tmp_path}/keys/k")
    assert again.last_trained == learner.last_trained > 0 and again.model is not None
    assert os.stat(f"{tmp_path}/keys/k").st_mode & 0o777 == 0o600
    assert decided(learner, o, draws).where("reason LIKE 'classifier%' OR reason LIKE 'uncertainty%' OR reason LIKE 'heuristic%'").count() > 0
    learner.reset()
    assert learner.outcomes() is None


def test_command_line(spark, tmp_path, capsys):
    from leafmill import cli

    write(tmp_path, a__docx=docx(p("The first page is here. It was read.")), b__docx=b"broken", c__txt=b"x")

    def run(**options):
        rows = cli.convert(spark, str(tmp_path), **options).collect()
        return {os.path.basename(r.path): r.status for r in rows}

    assert run(dry_run=True) == {"a.docx": "would_create", "b.docx": "would_create"}
    assert run() == {"a.docx": "created", "b.docx": "failed"}
    assert run() == {"a.docx": "skipped", "b.docx": "failed"}
    assert run(improve=True) == {"a.docx": "kept", "b.docx": "failed"}
    (tmp_path / "a.md").write_text("zzzzz bcdfgh")
    assert run(improve=True) == {"a.docx": "improved", "b.docx": "failed"}
    assert "The first page" in (tmp_path / "a.md").read_text()
    assert cli.formats("PDF, .docx") == (".pdf", ".docx") and cli.formats("") == cli.ls.FORMATS
    assert cli.main(["convert", str(tmp_path), "--formats", "xyz"]) == 1
    assert cli.main(["convert", str(tmp_path)]) == 1


def test_failed_files_are_tried_again(spark, tmp_path, capsys):
    """A file whose conversion fails is not in the state and is taken up in the next cycle."""
    from leafmill import cli

    folder, old = tmp_path / "in", time.time() - 3600
    folder.mkdir()

    def put(name, content):
        (folder / name).write_bytes(content)
        os.utime(folder / name, (old, old))

    def run():
        assert cli.main(["watch", "-d", str(folder), "--state", f"file://{tmp_path}/state", "--once"]) == 0
        return {os.path.basename(r.key): r.content_hash for r in inc.StateStore(spark, f"file://{tmp_path}/state/state").load().collect()}

    put("good.docx", docx(p("text of the first " * 20)))
    put("bad.docx", b"broken " * 50)
    assert set(run()) == {"good.docx"} and (folder / "good.md").exists() and not (folder / "bad.md").exists()
    assert "bad.docx" in capsys.readouterr().err
    os.remove(folder / "good.md")
    assert set(run()) == {"good.docx"} and not (folder / "good.md").exists()
    put("bad.docx", docx(p("now it can be read " * 20)))
    state = run()
    assert set(state) == {"good.docx", "bad.docx"} and (folder / "bad.md").exists() and len(state["bad.docx"]) == 32
    os.utime(folder / "good.docx", (old + 60, old + 60))  # touched, its content is the same
    assert set(run()) == {"good.docx", "bad.docx"} and not (folder / "good.md").exists()


def test_only_selected_files_are_opened(spark, tmp_path):
    write(tmp_path, a__docx=b"a", b__docx=b"b", c__docx=b"c")
    log = tmp_path / "log"
    log.mkdir()

    def counting(path):
        (log / os.path.basename(path)).write_text("opened")
        return open(src.local_path(path), "rb")

    paths = spark.createDataFrame([(str(tmp_path / "b.docx"),), (str(tmp_path / "missing"),)], "path string")
    got = {os.path.basename(r.path): (r.content, r.error) for r in src.read_files(paths, counting).collect()}
    assert bytes(got["b.docx"][0]) == b"b" and got["missing"][0] is None and "FileNotFoundError" in got["missing"][1]
    assert sorted(os.listdir(log)) == ["b.docx", "missing"]


def test_inspection(spark, tmp_path):
    import fcntl
    import hashlib

    write(tmp_path, a__pdf=b"x" * 200_000, b__pdf=b"y")
    held = open(tmp_path / "b.pdf", "rb")
    fcntl.flock(held, fcntl.LOCK_EX)
    paths = spark.createDataFrame([(str(tmp_path / n),) for n in ("a.pdf", "b.pdf", "gone.pdf")] + [(str(tmp_path),)], "path string")
    got = {os.path.basename(r.path): (r.content_hash, r.problem) for r in src.inspect_files(paths, wait=0.05).collect()}
    held.close()
    assert got == {"a.pdf": (hashlib.md5(b"x" * 200_000).hexdigest(), None), "b.pdf": (None, "locked"), "gone.pdf": (None, "not a file"), tmp_path.name: (None, "not a file")}


def test_recursive_listing_by_parts(tmp_path):
    from leafmill.streaming import watch

    for name in ("a.pdf", "s/b.pdf", "s/t/c.pdf", "u/d.pdf"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    for recursive, want in (("true", ["a.pdf", "b.pdf", "c.pdf", "d.pdf"]), ("false", ["a.pdf"])):
        reader = watch._Reader({"folders": str(tmp_path), "recursive": recursive})
        parts = reader.partitions({"cycle": 0}, {"cycle": 1})
        assert sorted(os.path.basename(r[0]) for x in parts for r in reader.read(x)) == want
