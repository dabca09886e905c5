"""Fill-in-middle against string operations, and the way back."""

import hashlib
import random
import re

from tidewater.llm import fill_in_middle as fim

R = random.Random(5)
TEXTS = [
    None, "", "a", "abc", "  ", "ab12 cd", "é日𝔘 xyé", "<P>", "a <S> b", "x<M", "<P", "S><", "\r\n\t", *("".join(R.choice("ab <>PSM1é日𝔘\n") for _ in range(R.randint(1, 60))) for _ in range(300)),
    " ".join(R.choice(["word", "é", "9"]) for _ in range(500_000)), "z" * 3_000_000 + " end",
]
SCHEMA = "doc_id long, text string, form string, output string, n long"


def plain_version(doc_id, text, seed=1):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    s = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(s[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_against_strings(spark):
    rows = [*enumerate(TEXTS), (3, TEXTS[3]), (None, "null id"), (None, None)]
    docs = spark.createDataFrame([(*r, "f", "o", 1) for r in rows], SCHEMA).repartition(3)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    order = lambda r: tuple(map(str, r))
    for seed in (1, 2):
        want = sorted(((i, *plain_version(i, t or "", seed), t or "") for i, t in rows), key=order)
        made = fim.fill_in_middle(docs, seed)
        got = fim.restore(made).collect()
        assert sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["restored"]) for r in got), key=order) == want
        assert all(r["output_sha256"] == sha(r["output"]) and r["restored_sha256"] == sha(r["restored"]) for r in got)
        once = fim.round_trip(docs, seed).collect()
        assert sorted(((r["doc_id"], r["output_sha256"], r["restored_sha256"]) for r in once), key=order) == sorted(((i, sha(x[4]), sha(x[5])) for i, *x in want), key=order)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_tokens_over_spans(monkeypatch):
    """However narrow the spans are that a text is looked at in, cuts are the same."""
    for span in (1, 2, 7):
        monkeypatch.setattr(fim, "SPAN", span)
        for i, t in enumerate(TEXTS[1:80]):
            n, form, parts, output = fim.arranged(i, t.encode())
            want = plain_version(i, t)
            assert (n, form, fim.spelled(output).decode()) == (want[0], want[1], want[4])
            assert form == "plain" or (parts[0].characters(), parts[1].characters()) == want[2:4]


def test_outputs_that_are_none(spark):
    rows = [("psm", "<P>a<S>b<M>c"), ("psm", "a<P>b<S>c<M>"), ("psm", "<P>a<M>b<S>c"), ("spm", "<S>c<P>a<M>b"), ("other", "x"), (None, "x"), ("psm", None), ("plain", "<P>"), ("psm", "")]
    got = fim.restore(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, form string, output string")).orderBy("i").collect()
    assert [r["restored"] for r in got] == ["acb", None, None, "abc", None, None, None, "<P>", None]
    assert fim.fill_in_middle(spark.createDataFrame([], SCHEMA)).collect() == [] and fim.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []
    assert fim.restore(spark.createDataFrame([], "form string, output string")).collect() == []
