import base64
import quopri
import random

import numpy as np

from seqspark.llm.leaks import Pieces, leaks, myers
from seqspark.llm.mail import own_paragraphs, parts, texts
from seqspark.llm.subjects import Terms, subjects

MULTI = """From: a@b
Content-Type: multipart/mixed;
 boundary="=_x"

preamble
--=_x
Content-Type: multipart/alternative; boundary="=_x.i"

--=_x.i
Content-Type: text/plain; charset="iso-8859-1"
Content-Transfer-Encoding: quoted-printable

{plain}
--=_x.i
Content-Type: text/html; charset=utf-8
Content-Transfer-Encoding: base64

{html}
--=_x.i--
--=_x
Content-Type: application/pdf
Content-Transfer-Encoding: base64

AAAA
--=_x
Content-Type: text/plain; name="n.txt"
Content-Disposition: attachment

attached words
"""


def test_parts():
    plain = quopri.encodestring("Se\xf1or = caf\xe9 ".encode("latin-1") + b"long " * 40).decode()
    html = base64.b64encode("<style>p{}</style><p>Uno&nbsp;dos</p>tr<b>es</b><br>cuatro".encode()).decode()
    found = parts(MULTI.format(plain=plain, html=html))
    assert [(p.html, p.attached) for p in found] == [(False, False), (True, False), (False, True)]
    assert found[0].content.startswith("Señor = café long") and found[2].content.strip() == "attached words"
    assert texts(MULTI.format(plain=plain, html=html))[1].split() == ["Uno", "dos", "tres", "cuatro"]
    assert texts(None) == [] and texts("") == []
    assert texts("just text\n\nno header") == ["just text\n\nno header"]
    assert parts("A: b\r\n\r\nbody\r\n")[0].content == "body\n"


def test_own_paragraphs():
    body = "Hi,\n\nOwn one. Two. Three.\n\nOn Fri, X <x@y> wrote:\n> Quoted. Text. Here.\n>> More.\n\nReply. To. It.\n\n-- \nName\nTel\n\n| piped. quote. here.\n\n-----Original Message-----\nFrom: z\n\nOld. Old. Old.\n"
    assert own_paragraphs("From: a\n\n" + body) == ["Hi,", "Own one. Two. Three.", "Reply. To. It."]
    html = "From: a\nContent-Type: text/html\n\n<p>A. B. C.</p><blockquote>X. <blockquote>Y.</blockquote> Z.</blockquote><p>D. E. F.</p>"
    assert [p.strip() for p in own_paragraphs(html)] == ["A. B. C.", "D. E. F."]


def edit(p, t):
    row = [0] * (len(t) + 1)
    for i, x in enumerate(p, 1):
        new = [i]
        for j, y in enumerate(t, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_myers():
    rng = np.random.default_rng(1)
    p, t = rng.integers(1, 4, (300, 12)), rng.integers(0, 4, (300, 14))
    assert myers(p, t).tolist() == [edit(list(a), [x if x else -1 for x in b]) for a, b in zip(p, t)]


def test_leaks_against_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([5, 12, 13, 40])))) for i in range(25)]
    docs = []
    for d in range(120):
        words = [rng.choice(vocab) for _ in range(30)]
        passage = items[rng.randrange(25)][1].split()
        k = rng.choice([8, 11, 12, 13, 40])
        cut = passage[:k]
        if rng.random() < 0.4 and len(cut) > 6:
            j = rng.randrange(len(cut))
            cut = rng.choice([cut[:j] + ["XX"] + cut[j + 1 :], cut[:j] + cut[j + 1 :], cut[:j] + ["new"] + cut[j:]])
        docs.append((d, "H: x\n\n" + " ".join(words[:10]) + ", > " + "-\n> ".join(cut).upper() + " " + " ".join(words[10:])))
    df = spark.createDataFrame([(*d, "z") for d in docs] + [(900, None, ""), (901, "", ""), (None, docs[0][1], "")], "doc_id int, text string, item_id string")
    it = spark.createDataFrame(items + [(77, None), (78, "")], "item_id int, passage string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in leaks(df, it).collect()}
    want = {}
    for d, text in docs:
        w = text.lower().replace(",", " ").replace(">", " ").replace("-", " ").split()[2:]
        for i, passage in items:
            p = passage.split()
            best = min((edit(p[o : o + 12], w) for o in range(len(p) - 11)), default=99)
            if best <= 1:
                want[d, i] = best
    assert {k: v for k, v in got.items() if k[0] is not None} == want and want
    assert {k[1] for k in got if k[0] is None} == {k[1] for k in want if k[0] == 0}
    assert leaks(df.limit(0), it).count() == 0 and leaks(df, it.limit(0)).count() == 0


def test_pieces_of_blocks(spark, monkeypatch):
    import seqspark.llm.leaks as L

    items = [(i, " ".join(f"v{i}x{j}" for j in range(20))) for i in range(30)]
    df = spark.createDataFrame([(i, "H: x\n\n" + t) for i, t in items], "doc_id int, text string")
    it = spark.createDataFrame(items, "item_id int, passage string")
    monkeypatch.setattr(L, "BLOCK_BYTES", 2000)
    assert sorted((r["doc_id"], r["item_id"]) for r in leaks(df, it).collect()) == [(i, i) for i in range(30)]
    assert len(Pieces([], 12, 1).key) == 0


def test_subjects(spark):
    a, b = ["hedge", "shrub", "lawn", "mulch", "spade"], ["violin", "chord", "choir", "tempo", "album"]
    rng = random.Random(6)
    text = lambda ws, n=4: " ".join(f"The {rng.choice(ws)} and the {rng.choice(ws)} were fine today." for _ in range(n))
    ex = [(text(a), ["garden"]) for _ in range(30)] + [(text(b), ["music"]) for _ in range(30)] + [(text(a) + "\n\n" + text(b), ["garden", "music"]) for _ in range(10)]
    docs = [(1, "H: x\n\n" + text(a)), (2, "H: x\n\n" + text(b) + "\n\n" + text(a)), (3, "H: x\n\n" + text(a, 2)), (4, "H: x\n\n> " + text(a)), (5, None), (6, ""), (7, "H: x\n\nNothing here. At all. Really not."), (None, "H: x\n\n" + text(b)), (8, "H: x\n\n" + "plain words only. " * 30_000 + "\n\n" + text(b))]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id int, text string, subject int")
    exs = spark.createDataFrame(ex + [(None, ["garden"]), ("x", None)], "body string, subjects array<string>")
    areas = spark.createDataFrame([("garden",), ("music",), ("unused",), (None,)], "subject string")
    got = sorted(map(tuple, subjects(df, exs, areas).collect()), key=str)
    assert got == sorted([(1, "garden"), (2, "garden"), (2, "music"), (None, "music"), (8, "music")], key=str)
    assert subjects(df.limit(0), exs, areas).count() == 0
    assert subjects(df, exs.limit(0), areas).count() == 0
    assert subjects(df, exs, areas.limit(0)).count() == 0


def test_held_out_accuracy():
    import pyarrow.parquet as pq

    rows = pq.read_table("/root/testdata/sf0.001/subject_examples.parquet").to_pylist()
    names = sorted({s for r in rows for s in r["subjects"]})
    ex = [(r["body"], r["subjects"]) for r in rows]
    right = total = 0
    for fold in range(3):
        m = Terms([e for i, e in enumerate(ex) if i % 3 != fold], names)
        m.calibrate([e for i, e in enumerate(ex) if i % 3 != fold], 3)
        for body, labels in ex[fold::3]:
            f = m.read(body.split("\n\n"), 3)
            score = m.leading(np.array([n for n, _ in f]), np.array([len(t) for _, t in f]), np.array([x for _, t in f for x in t], int), 0.9)
            got = {names[s] for s in np.nonzero((score > m.threshold).any(axis=0))[0]}
            right += got == set(labels)
            total += 1
    assert right / total > 0.95
