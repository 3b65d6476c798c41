import io
import os
import zipfile

from foliomill import providers
from foliomill.engine import Engine
from foliomill.operators.store import Collections
from foliomill.sources import files
from foliomill.streaming.incremental import ingest_new_files


def test_track_commit_search(spark, tmp_path):
    root, home = tmp_path / "files", tmp_path / "home"
    root.mkdir()
    (root / "a.txt").write_text("The cat sat on the mat.\n\nBirds sing in trees.")
    (root / "b.html").write_text("<html><head><style>x</style></head><body><h1>Kernel</h1><p>The kernel handles memory.</p></body></html>")
    (root / "c.md").write_text("excluded")
    (root / "d.pdf").write_bytes(b"%PDF")
    e = Engine(spark, str(home))
    e.include(f"{root}/*.*")
    e.exclude(f"{root}/*.md")
    assert {r["diff"] for r in e.track(str(root)).collect()} == {"added"}
    assert {r["diff"] for r in e.track(str(root)).collect()} == {"added"}  # unresolved additions stay
    assert e.commit(str(root)) == {"added": 2}
    assert [os.path.basename(r.file_path) for r in e.diff().collect()] == ["d.pdf"]  # unprocessable, stays open
    assert e.search("kernel memory").first().file_path.endswith("b.html")
    assert "[1]" in e.query("what does the kernel do with memory")
    path = e.query_to_files("what does the kernel do?", str(tmp_path / "out"))
    assert path.endswith("what_does_the_kernel_do_.json") and "kernel" in open(path).read() and "### Answers" in open(path[:-5] + ".md").read()
    assert Engine(spark, str(home)).patterns == {f"{root}/*.*": "include", f"{root}/*.md": "exclude"}  # a restart knows them
    assert e.cache.read("embed").count() == e.store.read(e.name).count()
    (root / "b.html").unlink()
    (root / "a.txt").write_text("Something else entirely here.")
    assert e.update(str(root)) == {"changed": 1, "removed": 1}
    assert e.update(str(root)) == {} and e.store.stats(e.name).first().files == 1
    assert e.store.names() == [e.name] and e.store.chunk_headers(e.name, f"{root}/a.txt").count() == 1


def test_decoders():
    assert files.decode_plain("ä".encode("cp1252")) == "ä" and files.decode_plain(b"\xff\xfea\x00") == "a" and files.decode_plain(b"a\x00b") is None
    assert files.decode_html(b"<p>A &amp; B</p><ul><li>x<li>y</ul><script>no</script>") == "A & B\n\n- x\n- y"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", '<w:d xmlns:w="u"><w:p><w:t>One</w:t></w:p><w:p/><w:p><w:t>Two</w:t></w:p></w:d>')
        z.writestr("word/media/i.png", b"png")
    assert files.decode_office(data.getvalue()) == "One\n\nTwo" and files.office_images(data.getvalue()) == [b"png"]
    assert files.decode_office(b"junk") is None and files.office_images(b"junk") == []
    assert [files.kind_of(p) for p in ("/a.PDF", "/b.Md", "/c.doc", "/d", "/e.jpeg", "/x.y/z")] == ["pdf", "plaintext", None, None, "image", None]


def test_stream_sees_each_file_once(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    (root / "a.txt").write_text("one\ntwo")
    seen = []
    run = lambda: ingest_new_files(spark, str(root), str(tmp_path / "cp"), lambda df, n: seen.extend(r.file_path for r in df.collect()))
    run()
    run()
    (root / "b.txt").write_text("three")
    run()
    assert [os.path.basename(p) for p in seen] == ["a.txt", "b.txt"]


def test_retry_and_ladder():
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 4:
            raise ConnectionError
        return "ok"

    assert providers.retry(flaky, sleep=waits.append) == "ok" and waits == [1.0, 2.0, 4.0]

    class Short(providers.Offline):
        def embed(self, texts):
            if len(texts[0].split()) > 6:
                raise ValueError
            return super().embed(texts)

    assert providers.embed_with_ladder(Short(8), "a b c d e f g h i j") is not None
    assert providers.embed_with_ladder(Short(8), " ".join("w" * 200)) is None


def test_catalogue_runs_on_the_smallest_tables(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_unreadable_changed_file_keeps_its_points_and_only_changed_files_are_read(spark, tmp_path):
    root, home = tmp_path / "files", tmp_path / "home"
    root.mkdir()
    (root / "a[1].txt").write_text("The cat sat on the mat.")
    (root / "b.txt").write_text("Birds sing in trees.")
    e = Engine(spark, str(home))
    e.include(f"{root}/**")
    assert e.update(str(root)) == {"added": 2}
    (root / "b.txt").write_bytes(b"no\x00text")
    assert e.update(str(root)) == {} and e.store.stats(e.name).first().files == 2
    assert [(os.path.basename(r.file_path), r["diff"]) for r in e.diff().collect()] == [("b.txt", "changed")]
    assert e.search("birds sing").first().file_path.endswith("b.txt") and e.files_found("birds sing").first().file_path.endswith("b.txt")


def test_a_write_that_dies_changes_nothing(spark, tmp_path):
    c = Collections(spark, str(tmp_path))
    rows = lambda *x: spark.createDataFrame(list(x), "file_path string, chunk_index int")
    c.write("n", rows(("/a", 0), ("/b", 0)))
    real = c.spark
    c.spark = None  # the line that makes a batch valid can't be written
    try:
        c.replace("n", rows(("/a", 7)))
    except AttributeError:
        pass
    c.spark = real
    see = lambda: sorted(tuple(r) for r in c.read("n").collect())
    assert see() == [("/a", 0), ("/b", 0)]
    c.replace("n", rows(("/a", 1)))
    c.add("n", rows(("/a", 2)))
    c.remove("n", rows(("/b", 0), ("/x", 0)))
    assert see() == [("/a", 1), ("/a", 2)] and c.catalogue().collect()[0].chunks == 2
    c.write("n", rows(("/z", 0)))
    assert see() == [("/z", 0)] and c.names() == ["n"]


def test_one_bad_text_costs_itself_only(spark):
    class Picky(providers.Offline):
        def embed(self, texts):
            if any(len(t.split()) > 3 for t in texts):
                raise ValueError("too long")
            if any("bad" in t for t in texts):
                raise RuntimeError
            return super().embed(texts)

    got = providers.embed_all(Picky(4), ["a b", "bad", "one two three four five"])
    assert [v is not None for v in got] == [True, False, True]
    assert providers.vision_mode(True, True) == "both" and providers.vision_text(Picky(4), b"", "both") is None
