import hashlib
import random
import re

from scrollmill.llm import infill

TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def brute(doc_id, text):
    text = text or ""
    units, named = TOKEN.findall(text), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(named[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def texts():
    rng = random.Random(5)
    some = ["", None, "a", "é", "<P>", "a <S> b", "x<M>", "<P<S", "\n", "🙂é\x00Z", "abc" * 500_000 + " é" * 400_000]
    return some + ["".join(rng.choice(["word", "Émile ", "\n", "<", "P>", "<S", "漢", "0", "🙂", "z" * 40]) for _ in range(rng.randint(0, 60))) for _ in range(200)]


def test_outputs_and_round_trip(spark):
    rows = [(i, t, "kept") for i, t in enumerate(texts())] + [(None, "null id here", "kept"), (5, "a <S> b", "kept"), (20, texts()[20], "kept")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string").repartition(3)
    got = infill.restore(infill.fill_in_middle(docs)).collect()
    assert len(got) == len(rows) and {r.form for r in got} == {"kept"}
    forms = set()
    for r in got:
        n, form, prefix, middle, output = brute(r.doc_id, r.text)
        f = r.fim
        assert (f.n, f.form, f.prefix_chars, f.middle_chars, f.output) == (n, form, prefix, middle, output)
        assert r.restored.text == (r.text or "")
        assert f.output_sha256 == hashlib.sha256(output.encode()).hexdigest() and r.restored.sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
        data = [(r.text or "").encode(), *infill.SENTINELS]
        assert b"".join(data[p.buffer][p.start : p.start + p.length] for p in f.pieces).decode() == output
        forms.add(form)
    assert forms == {"plain", "psm", "spm"}
    assert infill.restore(infill.fill_in_middle(docs.limit(0))).count() == 0


def test_parameters_and_descriptors():
    assert infill.transform(b"some words here", 1, plain_from=0)[1] == "plain"
    assert infill.transform(b"some words here", 1, plain_from=100, spm_below=100)[1] == "spm"
    assert infill.cut([(0, 0, 4), (1, 0, 3)], [0, 2, 4, 7]) == [(0, 0, 0), (0, 0, 2), (0, 2, 2), (0, 4, 0), (1, 0, 3), (1, 3, 0)]
    for order in infill.ORDERS.values():
        assert infill.arrange(infill.arrange(list("abcdef"), order), infill.inverse(order)) == list("abcdef")


def test_blocks_of_long_texts(monkeypatch):
    monkeypatch.setattr(infill, "BLOCK", 7)
    for i, t in enumerate(texts()[2:]):
        if len(t) < 5000:
            n, form, pieces = infill.transform(t.encode(), i)
            want = brute(i, t)
            assert (n, form, b"".join(infill.stream(pieces, t.encode())).decode()) == (want[0], want[1], want[4])
