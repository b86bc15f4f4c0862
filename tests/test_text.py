"""Text operators against plain-Python loops and hand cases."""

import itertools

from pyspark.sql import functions as F

from parley.functions import text as T
from parley.operators import text as X


def py_chunks(text, n):
    words = text.split()
    return [" ".join(words[i:i + n]) for i in range(0, len(words), n)]


def py_cap(pages, max_chars):
    """Expected capped text: whole pages (each with a newline) while the
    running length has not passed the cap, then cut at the cap."""
    ends = list(itertools.accumulate(len(p) + 1 for p in pages))
    kept = [p + "\n" for p, start in zip(pages, [0] + ends[:-1]) if start <= max_chars]
    text = "".join(kept)
    return text[:max_chars], len(text) > max_chars


CASES = ["", "one", "a b c", "  lead and trail  ", "a b　c\u001cd\te\nf", "w " * 5, "w " * 6,
         "x y z q r s\u0085t"]


def test_word_chunks_equal_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)], "doc_id long, text string")
    got = {}
    for r in X.word_chunks(df, n=5).collect():
        got.setdefault(r.doc_id, []).append((r.chunk_idx, r.text, r.n_words))
    for i, t in enumerate(CASES):
        exp = py_chunks(t, 5)
        rows = sorted(got.get(i, []))
        assert [x[1] for x in rows] == exp, (t, rows)
        assert [x[0] for x in rows] == list(range(len(exp)))
        assert sum(x[2] for x in rows) == len(t.split())


def test_char_cap_equal_python(spark):
    docs = {1: ["abc", "de"], 2: ["abcd", "e"], 3: ["abcde", "f"], 4: ["abcdefghij", "x"], 5: ["ab", "cd", "ef"]}
    rows = [(d, i, p) for d, ps in docs.items() for i, p in enumerate(ps)]
    pages = spark.createDataFrame(rows, "doc_id long, page_no int, page_text string")
    for cap in (5, 6, 7):
        got = {r.doc_id: (r.text, r.truncated, r.n_chars) for r in X.cap_document(pages, cap).collect()}
        for d, ps in docs.items():
            text, trunc = py_cap(ps, cap)
            assert got[d][:2] == (text, trunc), (cap, d, got[d])
            assert got[d][2] == len(text)


def test_char_offsets_small_blocks_equal_window(spark):
    rows = [(d, i, "x" * ((d * 7 + i * 3) % 11)) for d in range(3) for i in range(40)]
    pages = spark.createDataFrame(rows, "doc_id long, page_no int, page_text string")
    from parley.operators.scan import running_sum
    got = running_sum(pages, "doc_id", "page_no", (F.length("page_text") + 1).cast("long"), "s",
                      inclusive=False, block_rows=3).collect()
    acc = {}
    exp = {}
    for d, i, t in rows:
        exp[(d, i)] = acc.get(d, 0)
        acc[d] = acc.get(d, 0) + len(t) + 1
    assert {(r.doc_id, r.page_no): r.s for r in got} == exp


def test_cleanup_hand_cases(spark):
    cases = {
        "a $x^2$ b": "a b",
        "see [1, 2] and (Smith, 2020) ok": "see and ok",
        "body\nReferences\n[1] x": "body",
        "• one\n2. two": "one\ntwo",
        "Here's the cleaned text:\nreal": "real",
        "a  \t b\n\n\n\nc": "a b\n\nc",
        "\\textbf{x} y": "y",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "id long, text string")
    got = {r.id: r.c for r in df.select("id", T.clean_text("text").alias("c")).collect()}
    for i, (src, exp) in enumerate(cases.items()):
        assert got[i] == exp, (src, got[i])


def test_fillers_and_unescape(spark):
    df = spark.createDataFrame([("Umm, hmm... [laughs] humming hmmm",), ('a\\\\n \\"q\\" \\n',)], "t string")
    r = df.select(T.filler_count("t").alias("n"), T.unescape("t").alias("u")).collect()
    assert r[0].n == 3
    assert r[1].u == 'a\\n "q" \n'


def test_commentary_keeps_content(spark):
    from pyspark.sql import functions as F
    from parley.functions import text as T
    text = "Sure!\nSure, here is the text:\nHere's the cleaned text:\nSure enough, the pump failed in May.\nSure thing"
    row = spark.range(1).select(T.drop_commentary(F.lit(text)).alias("t")).first()
    assert row.t == "Sure enough, the pump failed in May.\nSure thing"


def test_unescape_by_hand(spark):
    from pyspark.sql import functions as F
    from parley.functions import text as T
    from parley.functions.literals import unescaped as _unescape
    for given, want in ((r"a\nb", "a\nb"), (r"a\\nb", r"a\nb"), (r"\\\"x", r'\"x'), ("\\'", "'"), (r"\\", "\\"), (r"\q", r"\q"), ("", "")):
        assert spark.range(1).select(T.unescape(F.lit(given)).alias("t")).first().t == want == _unescape(given)


# Line joins: text -> text that can be read aloud, written by hand.
JOINS = {
    "broken sentence": ("The device runs on an\nenterprise system.", "The device runs on an enterprise system."),
    "end of a sentence": ("It ends.\nnew line\n(really!)\nmore", "It ends.\nnew line\n(really!)\nmore"),
    "broken word": ("an exam-\nple, exam\u00ad\nple, exam\u2010\nple", "an example, example, example"),
    "word written with a hyphen elsewhere": ("a well-known house, a well-\nknown one", "a well-known house, a well-known one"),
    "word and sentence over three lines": ("cer-\ntified for out-\ndoor use", "certified for outdoor use"),
    "hyphen before a capital": ("the A-\nB line", "the A-\nB line"),
    "dash at the end is no hyphen": ("he said -\nthen left", "he said - then left"),
    "list": ("• one\n• two\n1. first\n2) second\n- dash", "• one\n• two\n1. first\n2) second\n- dash"),
    "list item that goes on": ("• one item that\n  goes on\n• two", "• one item that goes on\n• two"),
    "heading": ("Key Details\nThe text\n\nSecond Part\nMore text", "Key Details\nThe text\n\nSecond Part\nMore text"),
    "numbered heading": ("end.\n\n2.1 Results\nWe found", "end.\n\n2.1 Results\nWe found"),
    "no heading inside a paragraph": ("one two,\nThree Four\nfive", "one two, Three Four five"),
    "label": ("a colour touch screen, the newest of the first kind\nMemory: large", "a colour touch screen, the newest of the first kind\nMemory: large"),
    "long line": ("a line that is longer than forty characters\nGoes on", "a line that is longer than forty characters Goes on"),
    "short line": ("small line\nStays", "small line\nStays"),
    "blank lines": ("one\n\ntwo\n \t\nthree\n\n", "one\n\ntwo\n\nthree\n\n"),
    "white space at line ends": ("one \t\r\ntwo\r\n\r\nthree", "one two\n\nthree"),
    "indent": ("one\n   two\n\n   three\n   four", "one two\n\n   three four"),
    "other letters": ("die Über-\nführung, für\nédition", "die Überführung, für édition"),
    "empty": ("", ""),
    "one line": ("one", "one"),
}


def test_line_joins(spark):
    names = sorted(JOINS)
    df = spark.createDataFrame([(i, JOINS[n][0], "x") for i, n in enumerate(names)] + [(99, None, "x")], "doc_id int, text string, _extra string")
    out = X.join_lines(df)
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == ["doc_id", "text", "_extra", "n_lines_before", "n_lines_after", "words_before", "words_after"]
    for i, n in enumerate(names):
        before, after = JOINS[n]
        r = got[i]
        assert r.text == after, n
        assert (r.n_lines_before, r.n_lines_after) == (before.count("\n") + 1, after.count("\n") + 1), n
        assert (r.words_before, r.words_after) == (len(before.split()), len(after.split())), n
    assert got[99].text is None


def test_turns_keep_the_lines_that_continue_them(spark):
    from parley.operators import dialogue as D
    texts = {1: "Title\n\nSpeaker 1: one\nmore\n\n  \nSpeaker 2: \ttwo\nSpeaker 3: third\nand more\nSpeaker 1:", 2: "no label\nat all", 3: "", 4: None,
             5: "Speaker 12: x\nSpeaker 1 says: y\nSpeaker 2: z"}
    df = spark.createDataFrame(list(texts.items()), "episode_id long, text string")
    got = sorted(tuple(r) for r in D.dialogue_lines(df).collect())
    assert got == [(1, 2, "Speaker 1", "one\nmore"), (1, 6, "Speaker 2", "two"), (1, 9, "Speaker 1", ""), (5, 2, "Speaker 2", "z")]
    counts = {r.episode_id: (r.n_lines, r.n_turns, r.n_unread) for r in D.unread_lines(df).collect()}
    assert counts[1] == (7, 3, 3) and counts[2] == (2, 0, 2) and counts[3] == (0, 0, 0) and counts[5] == (3, 1, 2)


def test_previews_and_fillers(spark):
    from parley.operators import dialogue as D
    from parley.operators import episode as E
    seg = spark.createDataFrame([(1, 3, "Speaker 1", "x" * 60), (1, 5, "Speaker 2", "Umm, hmm [laughs] um"), (1, 6, None, "humm [sigh]"), (9, 0, "Speaker 1", "z")],
                                "episode_id long, seg_idx long, speaker string, text string")
    t = spark.createDataFrame([(1, "y" * 600), (2, "short")], "episode_id long, text string")
    got = {(r.episode_id, r.seg_idx): (r.transcript_preview, r.segment_preview, r.is_first) for r in E.previews(t, seg).collect()}
    assert got == {(1, 3): ("y" * 500 + "...", "x" * 50 + "...", True), (1, 5): ("y" * 500 + "...", "Umm, hmm [laughs] um...", False),
                   (1, 6): ("y" * 500 + "...", "humm [sigh]...", False), (2, None): ("short...", None, False)}
    counts = {(r.episode_id, r.speaker): (r.n_turns, r.n_fillers, r.n_laughs, r.n_sighs) for r in D.fillers_by_speaker(seg).collect()}
    assert counts == {(1, "Speaker 1"): (1, 0, 0, 0), (1, "Speaker 2"): (1, 3, 1, 0), (1, None): (1, 0, 0, 1), (9, "Speaker 1"): (1, 0, 0, 0)}
