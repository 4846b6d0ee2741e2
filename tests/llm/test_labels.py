"""Language, toxicity, personal data, token counts, mixing and page text."""

import random
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from pagelight.llm import language, mixing, pages, personal, tokens, toxicity
from pagelight.llm.queries import remainder

from .conftest import text

SYLLABLES = {"en": "th an er on ing ed ly", "de": "sch ung ein ich ß ver", "fr": "eau oi è tion que é"}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_language(spark):
    rng = random.Random(2)
    rows = [(i, sentence(rng, lang, rng.choice([3, 20, 200])), lang) for i in range(600) for lang in [rng.choice(list(SYLLABLES))]]
    rows += [(9000, None, "en"), (9001, "", "en"), (9002, "12 +-. 3", "de"), (None, "thing thing ering", None), (0, rows[0][1], rows[0][2])]
    block = spark.createDataFrame(rows, "doc_id bigint, content string, language string").withColumn("score", F.lit(1))
    model = language.fit(block.filter(remainder(5) != 0), 150)
    got = language.identify(block, model)
    held = got.filter(remainder(5) == 0).collect()
    want = {r[0]: r[2] for r in rows}
    known = [r for r in held if r["doc_id"] is not None and r["doc_id"] < 9000]
    assert sum(r["language_pred"] == want[r["doc_id"]] for r in known) >= 0.95 * len(known)
    everything = got.collect()
    assert len(everything) == len(rows) and all(0 <= r["score"] <= 1 for r in everything)
    odd = {r["doc_id"]: r for r in everything if r["doc_id"] in (9000, 9001, 9002)}
    assert all((r["language_pred"], r["score"], r["rejected"]) == ("und", 0.0, True) for r in odd.values()) and len(odd) == 3
    assert sum(r["rejected"] for r in everything) <= 3 + 0.02 * len(rows)


def test_language_without_labels(spark, block, nothing):
    assert language.fit(nothing) is None
    assert {r["language_pred"] for r in language.identify(block, None).collect()} == {"und"}
    assert language.identify(nothing, language.fit(block)).count() == 0
    assert language.identify(block, language.fit(block)).count() == block.count()


def test_toxicity(spark):
    rng = random.Random(4)
    stems = [f"zorgl{x}" for x in "abcdefgh"]
    rows, review = [], []
    for i in range(1500):
        w = text(rng, rng.choice([10, 60])).split()
        toxic = i % 5 == 0
        for _ in range(rng.randint(2, 4) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["idiot", "stupid,", "m0ron", *stems]))
        rows.append((i, " ".join(w)))
        review.append((i, "flagged" if toxic else "approved"))
    rows += [(9000, None), (9001, ""), (9002, "!!! ??? ..."), (0, rows[0][1]), (None, "you pathetic loser, you stupid clown")]
    review += [(9000, "approved"), (None, "flagged"), (5, None), (6, "raw")]
    block = spark.createDataFrame(rows, "doc_id bigint, content string").withColumn("flagged", F.lit(3)).withColumn("order", F.lit(1))
    reviewed = spark.createDataFrame(review, "doc_id bigint, status string")
    model = toxicity.fit(block, reviewed.filter(remainder(3) != 1))
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(block, model).collect()}
    held = [i for (i,) in map(tuple, spark.range(1500).withColumnRenamed("id", "doc_id").filter(remainder(3) == 1).collect())]
    right = sum((got[i] >= 0.7) == (i % 5 == 0) for i in held)
    assert right >= 0.95 * len(held)
    assert got[None] >= 0.7 and max(got[9000], got[9001], got[9002]) < 0.3
    assert all(0 <= s <= 1 for s in got.values())


def test_toxicity_without_labels(spark, block, nothing):
    none = spark.createDataFrame([], "doc_id bigint, status string")
    assert {r["score"] for r in toxicity.toxicity(block, toxicity.fit(block, none)).collect()} == {0.0}
    assert toxicity.toxicity(nothing, toxicity.fit(nothing, none)).count() == 0


def test_isotonic():
    steps, chance = toxicity._isotonic(np.array([3.0, 1.0, 2.0, 4.0]), np.array([0.0, 0.0, 1.0, 1.0]))
    assert list(chance) == [0.0, 0.5, 1.0] and list(steps) == [1.0, 2.5, 4.0]


def brute_spans(t):
    def luhn(digits):
        doubled = [int(d) * (1 + i % 2) for i, d in enumerate(digits[::-1])]
        return sum(d // 10 + d % 10 for d in doubled) % 10 == 0

    checks = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
    }
    return [(k, m.start(), m.end()) for k, (p, ok) in checks.items() for m in re.finditer(p, t) if ok(m[0])]


def test_spans_against_patterns():
    rng = random.Random(6)
    automaton = personal._automaton()
    for alphabet in ("a1.@-+", "0123.", "4 -1234567890", "+1 ()-.23", "é@a.b+1 _%"):
        for _ in range(1500):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
            got = [s for s in personal.find_spans(t, automaton) if s[0] in personal.BASE_KINDS]
            assert got == brute_spans(t), t


def test_personal_data(spark, block, nothing):
    t = "é mail a.b@c.org, 10.0.0.256 10.0.0.25 card 4111 1111-1111 1111 call +1 (555) 010-9999 see https://x.org/a?b=1. IBAN: DE44500105175407324931"
    got = personal.personal_data(spark.createDataFrame([(1, t), (2, None), (None, "")], "doc_id bigint, content string"))
    rows = {r["doc_id"]: [(s["kind"], t[s["start"] : s["end"]]) for s in r["spans"]] for r in got.collect()}
    assert rows == {2: [], None: [], 1: [
        ("email", "a.b@c.org"), ("ip", "10.0.0.25"), ("card", "4111 1111-1111 1111"), ("phone", "+1 (555) 010-9999"),
        ("url", "https://x.org/a?b=1"), ("account", "DE44500105175407324931")]}
    assert personal.personal_data(block).count() == block.count() and personal.personal_data(nothing).count() == 0


@pytest.mark.parametrize("t,want", [
    ("IBAN: DE89 3704 0044 0532 0130 00 is mine", ["DE89 3704 0044 0532 0130 00"]),
    ("IBAN GB82-WEST-1234-5698-7654-32.", ["GB82-WEST-1234-5698-7654-32"]),
    ("IBAN: DE89370400440532013000", ["DE89370400440532013000"]),
    ("Account number: GB82 WEST 1234 5698 7654 32", ["GB82 WEST 1234 5698 7654 32"]),
    ("iban: DE88 3704 0044 0532 0130 00", []),
    ("Konto: 123 456 789", ["123 456 789"]),
    ("Konto-Nr.: 123-456-789, Bank", ["123-456-789"]),
    ("Kontonummer 12345678 10 Euro", ["12345678"]),
    ("Account number:          12345678", ["12345678"]),
    ("Account        number        12345678 of 2020", ["12345678"]),
    ("account of 12 months in 2020", []),
    ("SWIFT: DEUTDEFF500", ["DEUTDEFF500"]),
    ("password: hunter22x", ["hunter22x"]),
    ("password=hunter2.", ["hunter2"]),
    ('{"password": "correct", "api_key": "correcthorse", "secret": "p@ss!w"}', ["correcthorse", "p@ss!w"]),
    ('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and', ["04dbebab91ab85687d33eeaaf9ac699e1188f962"]),
    ("token abc12345 and a secret garden", ["abc12345"]),
    ("customer no. 123456", ["123456"]),
    ("account 12-345678-1234567", ["12-345678-1234567"]),
    ("account" + " " * 200_000, []),
])
def test_account_forms(t, want):
    spans = personal.find_spans(t, personal._automaton())
    assert [t[a:b] for kind, a, b in spans if kind == "account"] == want


MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("chunk,overlap", [(64, 4), (300, 1), (1 << 16, 1 << 10)])
def test_token_counts(spark, block, rows, chunk, overlap):
    whole = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    odd = ["a" * 5000, " " * 3000, "x  y   z " * 300, "é\n\tü😀" * 400, "<s> </s> <unk> ▁ ▁▁a " * 100, " a " * 200, "\r\n" * 500]
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id bigint, content string")
    for frame, given in ((block, [r[:2] for r in rows]), (extra, [(1000 + i, t) for i, t in enumerate(odd)])):
        got = tokens.token_counts(frame, MODEL, chunk, overlap).collect()
        want = [(i, len((t or "").encode()), len(whole.encode(t or ""))) for i, t in given]
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_token_counts_of_nothing(nothing):
    assert tokens.token_counts(nothing, MODEL).count() == 0


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    full = set()
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        share = sum(weight[s] for s in order if s not in full)
        target = {s: 2 * sizes[s] if s in full else left * weight[s] / share for s in order}
        above = {s for s in order if target[s] > 2 * sizes[s] + 1e-9}
        if not above:
            return target
        full |= above


def check_mix(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id bigint, content string, source string").withColumn("size", F.lit("x"))
    mixed = mixing.mix(frame)
    got = mixed.collect()
    sizes, longest, taken = defaultdict(int), defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        sizes[s] += n
        longest[s] = max(longest[s], n)
    target = brute_targets(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
    budget = sum(target.values())
    assert len(got) == len(rows) and sum(taken.values()) <= budget + 1e-6
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(longest.values()) + 1e-6
    assert sorted(map(str, mixing.mix(frame).collect())) == sorted(map(str, got))
    plan = mixed._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_mix(spark, rows):
    check_mix(spark, [(r[0], r[1], r[3]) for r in rows if r[0] != 40])
    rng = random.Random(8)
    check_mix(spark, [(i, text(rng, rng.randrange(60)), rng.choice(["b", "a", "ä", "Z", None, "c", "a"])) for i in range(800)])


def test_mix_of_little(spark, nothing):
    assert mixing.mix(nothing).count() == 0
    only = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id bigint, content string, source string")
    assert [r["taken"] for r in mixing.mix(only).collect()] == [0, 0]


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_common_lines():
    rng = random.Random(9)
    for _ in range(400):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(14))] for _ in range(2))
        own = pages.common_lines(a, b)
        assert own == sorted(set(own)) and len(own) == lcs(a, b) == lcs([a[i] for i in own], b)


def test_page_lines():
    page = """<html><head><title>T</title><style>p{}</style></head><body class="sidebar-left"><header>Site</header><nav><li>x</nav>
    <div class="ad">Buy<p>now</div><article><header><h1>Head &amp; more</h1></header><p>One <b>two<br>three
    <p>caf&eacute; a < b <script>var t = "</p>";</script><!-- <p>no --><p class="share">Share</p><section id="comments"><p>Nice!</section>
    <aside>Side</aside><ul><li>i<li>j</ul><form><input>Name</form></article><p>After</p><footer>&copy; F</footer></body>"""
    assert [t for t, kind in pages.page_lines(page) if kind == pages.TEXT] == [
        "Head & more", "One two three", "café a < b", "i", "j"]
    assert [t for t, kind in pages.page_lines(page) if kind == pages.OPEN] == ["After"]
    assert pages.page_lines("") == [] and pages.page_lines("just text <b") == [("just text", pages.OPEN)]
    assert pages.page_lines("<script>never closed") == []


def test_main_text(spark):
    def page(own, mark="div"):
        return f"<div>Logo</div><{mark}><p>{own} one</p><p>{own} two</p></{mark}><div>Impressum</div>"

    rows = [(i, f"http://h{i % 3}.org/{i // 12}/{i}", page(f"text {i}")) for i in range(48)]
    rows += [(100, "http://alone.org/a", page("alone")), (101, None, None), (102, "http://[", ""), (103, "http://h0.org/0/1", page("same", "article")),
             (104, "http://h0.org/0/1", page("same", "article")), (5, rows[5][1], rows[5][2])]
    frame = spark.createDataFrame(rows, "doc_id bigint, url string, html string").withColumn("print", F.lit(1)).withColumn("lines", F.lit(2))
    got = {r["doc_id"]: r["text"] for r in pages.main_text(frame).collect()}
    assert all(got[i] == f"text {i} one\ntext {i} two" for i in range(48))
    assert got[100] == "Logo\nalone one\nalone two\nImpressum" and got[101] == got[102] == ""
    assert got[103] == got[104] == "same one\nsame two"
    assert pages.main_text(frame).count() == len(rows) and pages.main_text(frame.limit(0)).count() == 0


def test_main_text_of_copies(spark):
    def page(own, menu=""):
        return f"<nav>{menu}</nav><div>Logo</div><div><p>{own} one</p><p>{own} two</p></div><div>Impressum</div>"

    rows = [(0, "http://h.org/a", page("two")), (1, "http://h.org/a/print", page("two", "Back")), (2, "http://h.org/b", page("other"))]
    rows += [(i, "http://h.org/c?page=%d" % i, page("many")) for i in range(10, 80)]
    rows += [(i, f"http://h.org/d/{i}", page("more")) for i in range(80, 90)]
    rows += [(i, f"http://copies.org/{i}", page("only")) for i in range(90, 95)]
    frame = spark.createDataFrame(rows, "doc_id bigint, url string, html string")
    want = {i: page.split("<p>")[1].split(" one")[0] for i, _, page in rows}
    # One range, and ranges that a run of copies fills or crosses.
    for ranges in (1, 7, 40):
        spark.conf.set("spark.sql.shuffle.partitions", ranges)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = {r["doc_id"]: r["text"] for r in pages.main_text(frame).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert len(got) == len(rows)
        for i, own in want.items():
            kept = f"{own} one\n{own} two"
            assert got[i] == (f"Logo\n{kept}\nImpressum" if own == "only" else kept), (ranges, i, got[i])


@pytest.mark.parametrize("html, want", [
    ('<article><p>a <svg class="i"/> b</p><p>c</p></article>', ["a b", "c"]),
    ('<main><p>x</p><math/><p>y</p><svg><path d="1>2"/></svg><p>z</p></main>', ["x", "y", "z"]),
    ('<main><div class="share-price">12</div><div id="comments-on-the-law">law</div></main>', ["12", "law"]),
    ('<main><div class="ad-slot">buy</div><div class="share-buttons">send</div><p>text</p></main>', ["text"]),
    ("<article><p>a<script>never ends", ["a"]), ("<article><p>a<canvas>b<p>c</article>", ["ab", "c"]),
])
def test_hidden_elements_and_names_inside_of_articles(html, want):
    assert [text for text, kind in pages.page_lines(html) if kind == pages.TEXT] == want


def test_common_lines_of_long_pages():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(14))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        found, rest = pages.common_lines(a, b), iter(b)
        assert len(found) == len(set(found)) == best[-1][-1] and all(any(a[i] == y for y in rest) for i in found)
    long = list(range(50_000))
    assert pages.common_lines(long, long[::2] + [-1]) == long[::2]


@pytest.mark.parametrize("text, secret", [
    ("Api-Key: k9x8y7z6w5", "k9x8y7z6w5"), ("PassWord = hunter22x", "hunter22x"), ("Authorization: Bearer abc12345def", "abc12345def"),
    ("API KEY=zz81828384", "zz81828384"), ("İ İ PASSwd: secret99", "secret99")])
def test_cues_in_any_case(text, secret):
    spans = [text[a:b] for kind, a, b in personal.find_spans(text, personal._automaton()) if kind == "account"]
    assert spans == [secret]
