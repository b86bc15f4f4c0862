"""Queries over sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import dialogue as D
from parley.operators import text as X
from parley.operators.requests import with_fallback
from parley.plans.fixture_sql import WS_CHARS_SQL
from parley.plans.q_dialogue import CANDIDATES_CTE, _ok
from parley.plans.registry import query
from parley.session import new_folder
from parley.sinks import writers as W
from parley.sinks.files import write_files
from parley.sinks.writers import clean_file_name
from parley.sources import files as S
from parley.sources import fixtures as FX
from parley.sources import pcm


@query("src_ext_filter", r"""
    SELECT doc_id, path FROM f_paths WHERE lower(regexp_extract(path, '\.[^./]+$', 0)) = '.pdf'""")
def src_ext_filter(spark, sf_dir):
    """Paths whose extension is .pdf in any case (paths derived from documents)."""
    p = FX.paths(spark, sf_dir)
    return p.where(S.is_pdf(F.col("path")))


@query("src_decode_fallback", r"""
    SELECT doc_id, enc AS encoding_used, length(t) AS n_chars, t AS text FROM (
        SELECT doc_id,
               CASE WHEN doc_id % 2 = 0 OR NOT regexp_matches(l1, '[^\x{0}-\x{7f}]') THEN 'utf-8'
                    ELSE 'latin-1' END AS enc,
               regexp_replace(CASE WHEN doc_id % 2 = 0 THEN t0 ELSE l1 END, '\r\n?', chr(10), 'g') AS t
        FROM (SELECT doc_id, t0, regexp_replace(t0, '[^\x{0}-\x{ff}]', '?', 'g') AS l1
              FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(text, chr(10), chr(13) || chr(10))
                                        ELSE text END AS t0 FROM documents)))""")
def src_decode_fallback(spark, sf_dir):
    """Document bytes (UTF-8 for even ids, Latin-1 with '?' for other
    characters for odd ids, CR LF for ids divisible by 3) decoded with the
    UTF-8 -> Latin-1 fallback; line ends normalised."""
    e = FX.encoded(spark, sf_dir)
    d = e.select("doc_id", S.decode_text(F.col("content")).alias("_d"))
    return d.select("doc_id", "_d.encoding_used", F.length("_d.text").alias("n_chars"), "_d.text")


@query("src_segments", f"""
    SELECT episode_id, len(c) AS n_segments FROM q_cands
    WHERE len(c) > 0 AND len(list_filter(c, lambda l: NOT {_ok('l')})) = 0""", CANDIDATES_CTE)
def src_segments(spark, sf_dir):
    """Segments written by the segment sink and read by the segment scan;
    episodes whose parsed segment list is empty are absent."""
    path = new_folder(spark, "segments")
    W.write_segments(D.parse_replies(FX.replies(spark, sf_dir)), path)
    guarded = S.read_segments(spark, path).where(X.nonempty(F.col("speaker")))
    return guarded.groupBy("episode_id").agg(F.count("*").alias("n_segments"))


@query("src_voice_catalog", """
    SELECT conv_id, 'Voice ' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS name,
           'v' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS voice_id,
           'Voice ' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) || '; v'
               || CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS line
    FROM conversations""")
def src_voice_catalog(spark, sf_dir):
    """Voice-list JSON bodies flattened with ``inline``; one ``name; id`` line per voice."""
    c = FX.catalog(spark, sf_dir)
    v = c.select("conv_id", F.inline(S.flatten_catalog(F.col("body"))))
    return v.select("conv_id", "name", "voice_id", F.concat_ws("; ", "name", "voice_id").alias("line"))


@query("sink_clean_doc", f"""
    SELECT c.doc_id,
           'clean_' || regexp_extract(p.path, '([^/]+?)(\\.[^./]*)?$', 1) || '.txt' AS file_name,
           length(c.text) AS n_chars
    FROM (SELECT c.doc_id,
                 string_agg(coalesce(CASE WHEN r.status = 200 AND json_valid(r.body)
                          THEN trim(json_extract_string(r.body, '$.choices[0].message.content'), {WS_CHARS_SQL}) END, c.text)
                          || chr(10) || chr(10), '' ORDER BY c.chunk_idx) AS text
          FROM f_chunks c LEFT JOIN f_responses r ON c.doc_id = r.doc_id AND c.chunk_idx = r.chunk_idx
          GROUP BY c.doc_id) c
    JOIN f_paths p ON p.doc_id = c.doc_id""")
def sink_clean_doc(spark, sf_dir):
    """Cleaned-document sink rows: ``clean_{stem}.txt`` name and the text to
    write (each chunk + blank line); ``write_clean_docs`` writes them."""
    chunks = FX.chunks(spark, sf_dir)
    cleaned = with_fallback(chunks, FX.responses(spark, sf_dir, chunks))
    doc = X.chunks_to_doc(cleaned)
    p = FX.paths(spark, sf_dir)
    j = doc.join(p, "doc_id")
    return j.select("doc_id", clean_file_name(F.col("path")).alias("file_name"), F.length("text").alias("n_chars"))


@query("sink_clean_files", """
    SELECT 'clean_' || stem || CASE WHEN count(*) OVER (PARTITION BY stem) > 1 THEN '-' || substring(md5('in' || (doc_id % 2) || '/' || stem || '.pdf' || chr(10) || text || chr(10) || chr(10)), 1, 8) ELSE '' END
               || '.txt' AS file_name,
           octet_length(encode(text || chr(10) || chr(10))) AS n_bytes, sha256(text || chr(10) || chr(10)) AS sha256
    FROM (SELECT *, CASE WHEN doc_id % 16 = 3 THEN 'own' || doc_id ELSE CAST(doc_id // 2 AS VARCHAR) END AS stem FROM documents)""")
def sink_clean_files(spark, sf_dir):
    """Documents as files of their own: written by the file sink, names that
    clash told apart (two folders hold most stems twice), read back as bytes."""
    d, i = FX.documents(spark, sf_dir), F.col("doc_id")
    stem = F.when(i % 16 == 3, F.concat(F.lit("own"), i.cast("string"))).otherwise(F.floor(i / 2).cast("string"))
    path = F.concat(F.lit("in"), (i % 2).cast("string"), F.lit("/"), stem, F.lit(".pdf"))
    named = W.with_clean_names(d.select(path.alias("path"), F.concat("text", F.lit("\n\n")).alias("text")))
    out = new_folder(spark, "clean-files")
    W.write_clean_docs(named, out, per_file=True)
    back = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(out)
    return back.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


@query("sink_transcripts", """
    SELECT 'transcript_' || episode_id || '.txt' AS file_name, sha256(string_agg(speaker || ': ' || text, chr(10) ORDER BY seg_idx)) AS sha256
    FROM f_segments WHERE episode_id % 9 <> 0 GROUP BY episode_id""")
def sink_transcripts(spark, sf_dir):
    """Transcripts as files of their own, read back; nothing is written for
    empty ones (every ninth episode)."""
    t = D.render_transcripts(FX.segments(spark, sf_dir))
    t = t.withColumn("text", F.when(F.col("episode_id") % 9 != 0, F.col("text")).otherwise(F.lit("")))
    out = new_folder(spark, "transcripts")
    W.write_transcripts(t, out, per_file=True)
    back = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(out)
    return back.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.sha2("content", 256).alias("sha256"))


@query("src_pcm_frames", """
    SELECT episode_id, row_number() OVER (PARTITION BY episode_id ORDER BY seg_idx, i) - 1 AS t,
           CAST(trunc(greatest(-32768.0, least(32767.0, amp * 32767.0))) AS BIGINT) AS pcm
    FROM f_frames""")
def src_pcm_frames(spark, sf_dir):
    """PCM files, one an episode, written by the file sink and read by byte
    ranges: blocks of 100 frames, two or three to a task while those are few."""
    w = FX.waves(spark, sf_dir)
    name = F.concat(F.lit("episode_"), F.col("episode_id").cast("string"), F.lit(".pcm"))
    out = new_folder(spark, "pcm")
    write_files(w.select(name.alias("name"), "seg_idx", pcm.pcm_bytes(F.col("samples")).alias("content")), out, order="seg_idx")
    b = pcm.read_pcm(spark, out, block_frames=100, partition_bytes=500)
    b = b.select(F.regexp_extract("path", r"episode_(\d+)\.pcm$", 1).cast("long").alias("episode_id"), "first", "samples")  # once a block
    f = b.select("episode_id", "first", F.posexplode("samples").alias("i", "amp"))
    return f.select("episode_id", (F.col("first") + F.col("i")).alias("t"), F.round(F.col("amp") * 32767.0).cast("long").alias("pcm"))
