"""Sources: decoding fallback, extension test, stem, streaming ingest."""

import contextlib
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from parley.operators import text as X
from parley.sources import files as S
from parley.streaming import ingest, timeline


def py_read(b: bytes):
    for enc in ("utf-8", "latin-1"):
        try:
            return b.decode(enc).replace("\r\n", "\n").replace("\r", "\n"), enc
        except UnicodeDecodeError:
            continue


def test_decode_fallback(spark):
    cases = ["plain".encode(), "é ü".encode("utf-8"), "é ü".encode("latin-1"), b"a\r\nb\rc",
             "﻿bom".encode("utf-8"), b"", b"\xff\xfe\x00"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "id long, content binary")
    got = {r.id: (r.d.text, r.d.encoding_used) for r in df.select("id", S.decode_text(F.col("content")).alias("d")).collect()}
    for i, c in enumerate(cases):
        text, enc = py_read(c)
        assert got[i][0] == text, (c, got[i])
        assert got[i][1] == ("utf-8" if enc == "utf-8" else "latin-1")


def test_extension_and_stem(spark):
    from pathlib import Path
    paths = ["in/a.pdf", "in/b.PDF", "in/c.txt", "in/d", "x/e.tar.pdf", "f.pdf.txt"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = df.select("path", S.is_pdf(F.col("path")).alias("pdf"), S.stem(F.col("path")).alias("stem")).collect()
    for r in got:
        assert r.pdf == (Path(r.path).suffix.lower() == ".pdf")
        assert r.stem == Path(r.path).stem


def test_stream_text_equals_batch(spark):
    d = tempfile.mkdtemp(prefix="parley-stream-in-")
    texts = {"a.txt": "one two three four five six seven", "b.txt": "  x  y\n z ", "c.txt": ""}
    for name, t in texts.items():
        with open(os.path.join(d, name), "w") as f:
            f.write(t)
    got = ingest.stream_text_chunks(spark, d, n=3)
    got = sorted((os.path.basename(r.path), r.chunk_idx, r.text) for r in got.collect())
    batch = spark.createDataFrame(list(texts.items()), "path string, text string")
    exp = sorted((r.path, r.chunk_idx, r.text) for r in X.word_chunks(batch, n=3, key="path").collect())
    assert got == exp


def test_episode_state_out_of_order_batches(spark):
    """Turns split over several files (one per trigger) in scrambled order
    give the same timeline as the batch operator."""
    from parley.operators import episode as E
    rows = [(e, t, "assistant" if t % 2 else "user", "w" * (15 + (e * 7 + t * 11) % 40)) for e in range(4) for t in range(7)]
    d = tempfile.mkdtemp(prefix="parley-state-in-")
    groups = [[r for r in rows if r[1] % 3 == k] for k in (2, 0, 1)]   # later turns first
    for k, g in enumerate(groups):
        spark.createDataFrame(g, "conv_id long, turn long, role string, text string") \
            .coalesce(1).write.parquet(os.path.join(d, f"part{k}"))
        # move the single file up so that one file is one trigger
    files = []
    for k in range(3):
        sub = os.path.join(d, f"part{k}")
        for name in os.listdir(sub):
            if name.endswith(".parquet"):
                files.append(os.path.join(sub, name))
    flat = tempfile.mkdtemp(prefix="parley-state-flat-")
    for k, f in enumerate(files):
        os.link(f, os.path.join(flat, f"{k:02d}.parquet"))
        os.utime(os.path.join(flat, f"{k:02d}.parquet"), (1_000_000 + k, 1_000_000 + k))
    from parley.sources import fixtures as FX
    to_synth = lambda c: FX.synth_from(FX.segments_from(c))
    got = timeline.stream_episode_state(spark, flat, to_synth, max_files_per_trigger=1)
    got = {(r.episode_id, r.seg_idx): (r.ok_eff, r.prev_speaker, r.xfade_ms, r.end_ms) for r in got.collect()}
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    synth = to_synth(conv)
    exp = {(r.episode_id, r.seg_idx): (r.ok_eff, r.prev_speaker, r.xfade_ms, r.end_ms)
           for r in E.timeline_dynamic(synth).collect()}
    assert got == exp


def _turns(spark, folder, no, rows):
    """One Parquet file ``no`` of conversation turns in ``folder``."""
    import glob
    d = tempfile.mkdtemp(prefix="parley-turns-")
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string") \
        .coalesce(1).write.mode("overwrite").parquet(d)
    os.link(glob.glob(d + "/*.parquet")[0], os.path.join(folder, f"{no:02d}.parquet"))


def _to_synth(c):
    """Turns of 2 seconds; the text holds odd cases."""
    text = F.col("text")
    return c.select(F.col("conv_id").alias("episode_id"), F.col("turn").alias("seg_idx"), F.col("role").alias("speaker"),
                    F.when(text != "no duration", 2000).cast("long").alias("dur_ms"), F.when(text == "not ok", False).when(text != "no ok", True).alias("ok"))


def _tables(spark, run_dir):
    return [sorted(((r.episode_id, r.seg_idx) for r in t(spark, run_dir).collect()), key=str)
            for t in (timeline.placed_turns, timeline.waiting_turns, timeline.late_turns)]


def test_stream_resumes_and_loses_no_turn(spark):
    """Every turn is in the timeline, waits, or is late; replays count once; a
    gap ends when a turn has waited long enough, for that turn only."""
    import time
    src, run_dir = tempfile.mkdtemp(prefix="parley-gap-in-"), tempfile.mkdtemp(prefix="parley-gap-")

    def run(no, rows):
        _turns(spark, src, no, rows)
        timeline.stream_episode_state(spark, src, _to_synth, run_dir=run_dir, wait_ms=30_000)
        return _tables(spark, run_dir)
    assert run(0, [(1, t, "a", "x") for t in (0, 1, 3)] + [(2, t, "b", "x") for t in (1, 2)]) == [[(1, 0), (1, 1)], [(1, 3), (2, 1), (2, 2)], []]
    assert run(1, [(1, 1, "a", "x"), (3, 0, "a", "x"), (1, 3, "a", "other")]) == [[(1, 0), (1, 1), (3, 0)], [(1, 3), (2, 1), (2, 2)], []]
    time.sleep(31)
    got = run(2, [(1, t, "a", "x") for t in (6, 7)] + [(2, 3, "b", "x")])   # the timers of 1 and 2 are due
    assert got == [[(1, 0), (1, 1), (1, 3), (2, 1), (2, 2), (2, 3), (3, 0)], [(1, 6), (1, 7)], []]
    rows = [(1, 2, "a", "x"), (1, 3, "a", "x"), (2, 0, "b", "x"), (2, 0, "b", "x"), (1, 4, "a", "x")]
    want = [[(1, 0), (1, 1), (1, 3), (1, 4), (2, 1), (2, 2), (2, 3), (3, 0)], [(1, 6), (1, 7)], [(1, 2), (2, 0)]]
    assert run(3, rows) == want
    assert run(4, [(1, 2, "a", "x"), (2, 0, "b", "x")]) == want
    ends = {(r.episode_id, r.seg_idx): r.end_ms for r in timeline.placed_turns(spark, run_dir).collect()}
    assert [ends[1, i] for i in (0, 1, 3, 4)] == [3500, 5050, 6600, 8150] and [ends[2, i] for i in (1, 2, 3)] == [3500, 5050, 6600]


def test_timer_ends_a_gap_without_new_turns(spark):
    import time
    src, run_dir = tempfile.mkdtemp(prefix="parley-timer-in-"), tempfile.mkdtemp(prefix="parley-timer-")
    _turns(spark, src, 0, [(1, t, "a", "x") for t in (0, 2, 3, 5)])
    q = timeline.start_episode_state(spark, src, _to_synth, run_dir, wait_ms=1500, every="500 milliseconds")
    try:
        end = time.time() + 90
        while time.time() < end and q.isActive:
            with contextlib.suppress(Exception):   # before the first batch there is no sink
                if timeline.placed_turns(spark, run_dir).count() == 4:
                    break
            time.sleep(0.5)
    finally:
        q.stop()
    assert [(r.seg_idx, r.end_ms) for r in timeline.placed_turns(spark, run_dir).orderBy("seg_idx").collect()] == [(0, 3500), (2, 5050), (3, 6600), (5, 8150)]


def test_stream_side_tables(spark):
    """Null indexes, episodes, durations and results fail no job."""
    src, run_dir = tempfile.mkdtemp(prefix="parley-odd-in-"), tempfile.mkdtemp(prefix="parley-odd-")
    rows = [(1, 0, "a", "no duration"), (1, 1, None, "x"), (1, 2, None, "x"), (1, None, "a", "x"), (None, 0, "a", "x"), (None, None, "a", "x"),
            (1, 3, "b", "no ok"), (1, 4, "b", "not ok"), (1, 5, "b", "x")]
    _turns(spark, src, 0, rows)
    got = timeline.stream_episode_state(spark, src, _to_synth, run_dir=run_dir).collect()
    from parley.operators import episode as E
    batch = E.timeline_dynamic(_to_synth(spark.createDataFrame(rows, timeline.CONV_SCHEMA))).where("episode_id is not null and seg_idx is not null").collect()
    fields = timeline.PLACED
    assert sorted(tuple(r[c] for c in fields) for r in got) == sorted((tuple(r[c] for c in fields) for r in batch), key=lambda t: t[:2]) and len(got) == 6
    assert sorted(((r.episode_id, r.seg_idx) for r in timeline.unplaced_turns(spark, run_dir).collect()), key=str) == [(1, None), (None, 0), (None, None)]
    assert [r.seg_idx for r in timeline.turns_without_duration(spark, run_dir).collect()] == [0]


def test_streams_read_tables_that_are_folders(spark):
    """Tables as Spark writes them, folders of several files, give all their
    rows, as single files do; a source without a match is empty."""
    src = tempfile.mkdtemp(prefix="parley-folders-")
    docs = [(i, f"a{i} b{i} c{i}", "en", "s", 8) for i in range(20)]
    turns = [(e, t, "a", "x") for e in range(4) for t in range(5)]
    spark.createDataFrame(docs, ingest.DOCS_SCHEMA).repartition(3).write.parquet(f"{src}/documents.parquet")
    spark.createDataFrame(turns, timeline.CONV_SCHEMA).repartition(3).write.parquet(f"{src}/conversations.parquet")
    want = sorted((i, k, t) for i in range(20) for k, t in enumerate((f"a{i} b{i}", f"c{i}")))
    for glob in ("documents.parquet", "doc*.parquet"):
        assert sorted((r.doc_id, r.chunk_idx, r.text) for r in ingest.stream_chunks(spark, src, n=2, glob=glob, max_files_per_trigger=2).collect()) == want
    got = timeline.stream_episode_state(spark, src, _to_synth, glob="conversations.parquet").collect()
    assert sorted((r.episode_id, r.seg_idx) for r in got) == [(e, t) for e in range(4) for t in range(5)]
    assert ingest.stream_chunks(spark, src, n=2, glob="none.parquet").collect() == []
    assert timeline.stream_episode_state(spark, src, _to_synth, glob="none.parquet").collect() == []


def test_replayed_documents_give_their_chunks_once(spark):
    """The same document in two files, in one run and in a later one; a batch
    that is run again adds nothing; documents without an id all stay."""
    src, run_dir = tempfile.mkdtemp(prefix="parley-replay-in-"), tempfile.mkdtemp(prefix="parley-replay-")

    def put(no, rows):
        d = tempfile.mkdtemp(prefix="parley-docs-")
        spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], ingest.DOCS_SCHEMA).coalesce(1).write.mode("overwrite").parquet(d)
        import glob
        os.link(glob.glob(d + "/*.parquet")[0], os.path.join(src, f"{no:02d}.parquet"))

    def run():
        out = ingest.stream_chunks(spark, src, n=2, run_dir=run_dir, max_files_per_trigger=1)
        return sorted(((r.doc_id, r.chunk_idx, r.text) for r in out.collect()), key=str)
    put(0, [(1, "a b c"), (2, "d"), (None, "e"), (None, "f")])
    put(1, [(1, "a b c"), (3, "g"), (None, "e")])
    want = [(1, 0, "a b"), (1, 1, "c"), (2, 0, "d"), (3, 0, "g"), (None, 0, "e"), (None, 0, "f")]
    assert run() == sorted(want, key=str)
    put(2, [(2, "changed"), (4, "h")])
    assert run() == sorted([*want, (4, 0, "h")], key=str)
    again = spark.createDataFrame([(4, 0, 1, "h")], "doc_id long, chunk_idx int, n_words int, text string")
    ingest.write_batch(f"{run_dir}/out")(again, 2)
    assert run() == sorted([*want, (4, 0, "h")], key=str)


def _content(folder):
    out = {}
    for name in os.listdir(folder):
        if name != "_SUCCESS" and not name.endswith(".crc"):
            with open(os.path.join(folder, name), "rb") as f:
                out[name] = f.read()
    return out


def test_writers(spark):
    from parley.sinks import writers as W
    out = tempfile.mkdtemp(prefix="parley-sink-")
    texts = {"in/a.pdf": "first\n\n", "in/b.PDF": "sécond \r\n 中\n\n", "else/A.pdf": "third", "in/c": "", "": "none", "x/.pdf": "dot"}
    docs = spark.createDataFrame([*texts.items(), (None, "null")], "path string, text string")
    named = W.with_clean_names(docs)
    got = {r.path: r.file_name for r in named.collect()}
    assert got["in/b.PDF"] == "clean_b.txt" and got["in/c"] == "clean_c.txt"
    assert got["in/a.pdf"].startswith("clean_a-") and got["else/A.pdf"].startswith("clean_A-") and got[None].startswith("clean_unnamed-")
    assert len({n.lower() for n in got.values()}) == len(got) == 7
    W.write_clean_docs(named, out + "/table")
    assert spark.read.parquet(out + "/table").count() == 7
    W.write_clean_docs(named, out + "/clean", per_file=True)
    assert _content(out + "/clean") == {n: (texts.get(p, "null") if p is not None else "null").encode() for p, n in got.items()}
    seg = spark.createDataFrame([(1, 0, "Speaker 1", ""), (1, 1, "Speaker 2", "x")],
                                "episode_id long, seg_idx long, speaker string, text string")
    W.write_segments(seg, out + "/seg")
    assert spark.read.parquet(out + "/seg").count() == seg.count() == 2
    t = spark.createDataFrame([(1, "a\nb"), (2, ""), (3, None)], "episode_id long, text string")
    W.write_transcripts(t, out + "/t", per_file=True)
    W.write_transcripts(t, out + "/p")
    assert _content(out + "/t") == {"transcript_1.txt": b"a\nb"} and [r.text for r in spark.read.parquet(out + "/p").collect()] == ["a\nb"]


def test_file_sink_joins_the_rows_of_a_name_in_order(spark):
    from parley.sinks.files import write_files
    out = tempfile.mkdtemp(prefix="parley-parts-")
    rows = spark.createDataFrame([(f"f{i % 3}", i, f"{i},") for i in range(30)] + [("g", 0, None)], "name string, k int, content string").repartition(7)
    write_files(rows, out, order="k")
    assert _content(out) == {f"f{j}": "".join(f"{i}," for i in range(30) if i % 3 == j).encode() for j in range(3)} | {"g": b""}
    write_files(rows.limit(0), out + "/none")
    assert os.listdir(out + "/none") == ["_SUCCESS"]


@pytest.mark.parametrize("bad", ["a/b", None, "", "_x", "f0"])
def test_a_failed_file_job_leaves_no_file(spark, bad):
    """One task fails on its last row, after other tasks have ended."""
    from parley.sinks.files import write_files
    out = tempfile.mkdtemp(prefix="parley-fail-") + "/out"
    rows = spark.createDataFrame([(f"f{i}", i) for i in range(40)] + [(bad, 100)], "name string, k int")
    if bad == "f0":   # comes again in the task, behind another name
        rows = rows.coalesce(1).sortWithinPartitions("k")
    else:
        rows = rows.repartitionByRange(4, "k").sortWithinPartitions("k")
    with pytest.raises(Exception, match="no file name|do not follow"):
        write_files(rows.withColumn("content", F.col("k").cast("string")), out)
    assert not os.path.exists(out) or os.listdir(out) == []


def test_pcm_ranges_grow_with_the_input(spark):
    """Many small ranges are not a task each, and the blocks of a task share
    Arrow batches."""
    import numpy as np
    from parley.sources import pcm
    out = tempfile.mkdtemp(prefix="parley-pcm-many-")
    x = np.arange(30_000, dtype="<i2")
    for k in range(30):
        (x + k).astype("<i2").tofile(f"{out}/e{k:02d}.pcm")
    reader = pcm.PcmReader({"path": out, "block_frames": "100", "partition_bytes": "500"})
    parts = reader.partitions()
    assert len(parts) <= pcm.MOST_TASKS + 1   # 1,800,000 bytes by 500 would be 3,000
    seen = sorted((p, b) for r in parts for p, at, n in r.value for b in range(at, at + n))
    assert len(seen) == len(set(seen)) == 30 * 300
    whole = pcm.PcmReader({"path": out, "block_frames": "100"})
    assert len(whole.partitions()) == 1 and sum(1 for _ in whole.read(whole.partitions()[0])) <= 8
    got = pcm.read_pcm(spark, out, 100, 500).orderBy("path", "block").collect()
    for k in range(30):
        own = [r for r in got if r.path.endswith(f"e{k:02d}.pcm")]
        assert np.array_equal(np.concatenate([r.samples for r in own]), (x + k) / 32767.0)


def test_pcm_files_by_byte_ranges(spark):
    import numpy as np
    from parley.operators import blocks as B
    from parley.sinks import writers as W
    from parley.sources import pcm
    out = tempfile.mkdtemp(prefix="parley-pcm-")
    x = {1: np.arange(-500, 501) / 400.0, 2: np.array([0.5]), 3: np.zeros(0)}
    raw = {k: np.trunc(np.clip(v * 32767, -32768, 32767)).astype("<i2") for k, v in x.items()}
    for k, v in raw.items():
        with open(f"{out}/e{k}.pcm", "wb") as f:
            f.write(v.tobytes())
    with open(f"{out}/other.txt", "wb") as f:
        f.write(b"x")
    for block, size in ((64, 256), (64, 1), (5000, 10_000), (1, 900)):
        df = pcm.read_pcm(spark, out, block, size)
        rows = df.orderBy("path", "block").collect()
        for k, v in raw.items():
            own = [r for r in rows if r.path.endswith(f"e{k}.pcm")]
            assert [r.first for r in own] == [i * block for i in range(-(-len(v) // block))]
            assert np.array_equal(np.concatenate([r.samples for r in own] or [np.zeros(0)]), v / 32767.0)
    assert pcm.read_pcm(spark, out, 64, 1024).rdd.getNumPartitions() >= 2      # one file, several tasks
    assert pcm.read_pcm(spark, f"file:{out}/e1.pcm", 64).count() == 16
    # The samples of blocks go to files and come back.
    waves = spark.createDataFrame([(1, 0, [float(a) for a in x[1][:300]]), (2, 0, [0.25])], "episode_id long, seg_idx long, samples array<double>")
    W.write_episode_audio(B.mix(waves, 0, 37, 5), out + "/episodes")
    back = {r.path[-13:]: r.samples for r in pcm.read_pcm(spark, out + "/episodes", 1000).collect()}
    assert np.array_equal(back["episode_1.pcm"], raw[1][:300] / 32767.0) and back["episode_2.pcm"] == [8191 / 32767.0]
    with open(f"{out}/odd.pcm", "wb") as f:
        f.write(b"abc")
    with pytest.raises(Exception, match="ends within a sample"):
        pcm.read_pcm(spark, out).count()


def test_local_session_without_a_checkpoint_folder():
    """With an empty configuration folder the private folder is used."""
    import subprocess
    import sys
    code = ("from parley.session import local_session, cut_lineage, checkpoint_dir\n"
            "s = local_session(1, 1)\n"
            "assert not s.sparkContext.getConf().get('spark.checkpoint.dir', None)\n"
            "print(cut_lineage(s.range(3)).count(), checkpoint_dir(s) == checkpoint_dir(s))")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"SPARK_CONF_DIR": tempfile.mkdtemp(prefix="parley-conf-"), "PYTHONPATH": root, "PYSPARK_GATEWAY_PORT": ""}
    env.pop("PYSPARK_GATEWAY_PORT")
    run = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=180)
    assert run.stdout.strip().endswith("3 True"), run.stderr[-2000:]


def test_stored_tables_can_be_removed(spark):
    from parley import session
    before = dict(session._folders)
    session._folders.clear()   # those of other tests stay
    try:
        table = session.cut_lineage(spark.range(5))
        path = session._folders[spark.sparkContext.applicationId][0]
        assert table.count() == 5 and session.new_folder(spark, "unused") != path
        assert session.remove_folders(spark) == 1 and not os.path.exists(path.removeprefix("file:")) and session.remove_folders(spark) == 0
    finally:
        session._folders.clear()
        session._folders.update(before)


def test_read_pdfs_and_text_files(spark):
    d = tempfile.mkdtemp(prefix="parley-files-")
    for name, data in {"a.pdf": b"%PDF-1", "b.PDF": b"%PDF-2", "c.txt": "café\r\nx".encode("latin-1"),
                       "d.txt": "naïve\nline".encode("utf-8"), "e": b"none"}.items():
        with open(os.path.join(d, name), "wb") as f:
            f.write(data)
    pdfs = sorted(os.path.basename(r.path) for r in S.read_pdfs(spark, d).select("path").collect())
    assert pdfs == ["a.pdf", "b.PDF"]
    txt = {os.path.basename(r.path): (r.text, r.encoding_used) for r in S.read_text_files(spark, d).collect()}
    assert txt == {"c.txt": ("café\nx", "latin-1"), "d.txt": ("naïve\nline", "utf-8")}


def test_manifest_writer(spark):
    from parley.operators import episode as E
    from parley.sinks import writers as W
    counts = spark.createDataFrame([(1, 3, 2), (2, 0, 0), (3, 1, 0)], "episode_id long, n_ok long, n_ok_openai long")
    m = E.manifests(counts, F.to_date(F.lit("2024-05-17")))
    out = tempfile.mkdtemp(prefix="parley-manifest-")
    W.write_manifest(m, out + "/m")
    back = {(r.episode_id, r.provider): (r.file_name, r.date) for r in spark.read.parquet(out + "/m").collect()}
    assert back[(1, "openai")] == ("_podcast.mp3", "2024-05-17")
    assert back[(3, "eleven")] == ("final_podcast.mp3", None)
    assert (2, "bark") not in back and (3, "openai") not in back
