"""Order, alignment and cuts of outputs, claims in texts, diffs, and small cases of the batteries."""

from pyspark.sql import functions as F

from tracelode.operators import clocks, knowledge, ordered, outputs, shares, views


def test_ls_orders():
    assert outputs.ls_out_of_order("ls -1", "a\nB\nc") is False  # folded
    assert outputs.ls_out_of_order("ls -1", "f2\nf10\nf9") is True
    assert outputs.ls_out_of_order("ls -1", "f2\nf9\nf10") is False  # natural
    assert outputs.ls_out_of_order("ls -t1", "c\nb\na") is None and outputs.ls_out_of_order("ls", "b\na\nc") is None
    rows = "total 3\n" + "\n".join(f"-rw-r--r-- 1 u g 10 Jan 1 10:00 {n}" for n in "bac")
    assert outputs.ls_out_of_order("cd x && ls -l", rows) is True
    assert outputs.ls_out_of_order("ls -1", "a\nb") is None


def test_log_and_grep_orders():
    log = "commit a\nDate:   Mon Oct 6 10:00:00 2025 +0000\n\ncommit b\nDate:   Sun Oct 5 10:00:00 2025 +0000\n\ncommit c\nDate:   {}\n"
    assert outputs.log_out_of_order("git log", log.format("Sat Oct 4 10:00:00 2025 +0000")) is False
    assert outputs.log_out_of_order("git log", log.format("Tue Oct 7 10:00:00 2025 +0000")) is True
    assert outputs.log_out_of_order("git log --reverse", log.format("Tue Oct 7 10:00:00 2025 +0000")) is None
    assert outputs.grep_out_of_order("grep -n x f", "1:a\n5:b\n3:c") is True
    assert outputs.grep_out_of_order("grep -rn x .", "a:1:x\na:5:y\nb:2:z") is False
    assert outputs.grep_out_of_order("grep x f", "1:a\n5:b\n3:c") is None


def test_alignment_and_cuts():
    good = "-rw-r--r-- 1 u g   10 Jan 1 10:00 a\n-rw-r--r-- 1 u g  100 Jan 1 10:00 b\n-rw-r--r-- 1 u g 1000 Jan 1 10:00 c"
    assert outputs.misaligned("ls -l", good) == [] and outputs.misaligned("ls -l", good.replace("g  100", "g 100")) == ["ls_long"]
    assert outputs.misaligned("git status", "modified: a") == ["git_status"]
    assert outputs.misaligned("pytest", "== a ==\n=== b ==") == ["pytest_banner"]
    assert outputs.cut_sizes("é😀... [12 characters truncated] ...xyz") == ("middle", 3, 3, 12)
    assert outputs.cut_sizes("whole") is None


def test_claims_do_not_overlap():
    text = "See https://a.b/c1234567. Ran `git log -3` in src/app/main.py, commit 3f2a9bc at 10:30:00; 12,345 rows, in 2024, \"a quoted passage\"."
    found = outputs.extract_claims(text)
    kinds = {k: v for k, v, _ in found}
    assert kinds["url"] == "https://a.b/c1234567" and kinds["path"] == "src/app/main.py" and kinds["hex_id"] == "3f2a9bc"
    assert kinds["number"] == "12345" and kinds["command"] == "git log -3" and kinds["quoted"] == "a quoted passage"
    assert [v for k, v, _ in found if k == "number"] == ["12345"]
    assert all(text[s:].startswith(v) for k, v, s in found if k in ("url", "path", "hex_id"))
    assert outputs.extract_claims("") == []


def test_diffs():
    patch = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,2 @@\n keep\n-old\n+++ new\ndiff --git a/gone b/gone\n--- a/gone\n+++ /dev/null\n@@ -1 +0,0 @@\n-bye\ndiff --cc m\n@@@ -1 -1 @@@\n++ merged"
    assert outputs.parse_diff(patch) == [("x.py", ["++ new"], ["old"]), ("gone", [], ["bye"])]
    assert outputs.parse_diff("") == []


def test_arrow_forms(spark):
    df = spark.createDataFrame([("ls -1", "b\na\nc"), (None, None)], "c string, o string")
    got = df.select(outputs.order_checks("c", "o").alias("x"), outputs.claims("o").alias("y"), outputs.diffs("o").alias("z")).collect()
    assert got[0].x.ls is True and got[1].x.ls is None and got[1].y == [] and got[1].z == []


def test_residuals_leave_one_out(spark):
    rows = [("a", k, float(v)) for k, v in enumerate([1, 5, 2, 9])] + [("b", k, float(v)) for k, v in enumerate([3, 3, 8])] + [("c", 0, 1.0)]
    got = clocks.residuals(spark.createDataFrame(rows, "g string, k int, v double"), ["g"], "k", "v").collect()
    import statistics

    want = {(g, k): v - statistics.median(w for h, j, w in rows if h == g and j != k) for g, k, v in rows if g != "c"}
    assert {(r.g, r.k): r.residual for r in got} == want


def test_brackets_and_gaps(spark):
    ev = spark.createDataFrame([("s", "main", q, kind, t, e) for q, (kind, t, e) in enumerate([("user", 0, None), ("assistant", 10, 9), ("result", 20, None), ("call", 30, 5), ("user", 35, None), ("assistant", 40, 50)])], "session_id string, stream string, seq int, kind string, t long, e long")
    b = clocks.bracket_bounds(ev, ["session_id", "stream"], "seq", "t", "e", F.col("kind").isin("assistant", "call"), F.col("kind").isin("result", "user"))
    assert sorted((r.seq, r.lo, r.hi) for r in b.collect()) == [(1, -9, 1), (3, 15, 25), (5, -15, -10)]
    r = clocks.brackets(b, ["session_id", "stream"], "seq", tolerance=20).first()
    assert (r.n, r.lo, r.hi, r.gap, r.inconsistent, r.at_lo, r.at_hi) == (3, 15, -10, 25, True, 3, 5)
    assert clocks.one_step(b, ["session_id", "stream"], "seq", 20).first().consistent is True
    gaps = clocks.reaction_gaps(ev, ["session_id", "stream"], "seq", "t")
    assert [(g.seq, g.gap) for g in gaps.collect()] == [(3, 10)]


def test_views_and_knowledge(spark):
    t = spark.createDataFrame([("s", 0, "u", None, "path a/b.py"), ("s", 1, "r", "c", "real"), ("s", 2, "r", "c", "again"), ("s", 3, "a", None, "a/b.py x/y.py")], "key string, pos int, role string, call string, text string")
    specs = spark.createDataFrame([("v1", "s", "c", "fake"), ("v2", "s", "none", "fake")], "view_id string, key string, call string, claimed string")
    got = {(r.view_id, r.pos): (r.text, r.spliced) for r in views.spliced(t, specs, "key", "pos", "call", F.col("role") == "r", "text").collect()}
    assert got["v1", 1] == ("fake", True) and got["v1", 2] == ("again", False) and got["v2", 1] == ("real", False) and len(got) == 8
    tok = knowledge.tokens(t, ["key"], "pos", F.col("text"), keep=("role",))
    first = {r.token: (r.shown, r.before) for r in knowledge.first_use(tok.where("role = 'u'"), tok.where("role = 'a'"), ["key"], "pos").collect()}
    assert first == {"a/b.py": (0, False), "x/y.py": (None, True)}


def test_empty_tables(spark):
    e = spark.createDataFrame([], "session_id string, seq int, kind string, stream string, v double")
    assert shares.zero_tail(e, "session_id", F.col("v") > 0).first().sessions == 0
    assert ordered.precedence(e, ["session_id"], "seq", "kind").count() == 0
    assert ordered.overlap(e.select("kind"), e.select("kind")).first().both == 0
