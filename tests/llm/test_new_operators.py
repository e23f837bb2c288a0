import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from dotspark.llm import lexical_search, secret_scan, spelling


def lowered(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


# spelling variants


def brute_words(docs):
    counts = Counter()
    for i, t, *_ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_variants(words):
    forms, out = {}, {}
    for w, n in words.items():
        close = sorted((-words[v], v) for v in words if near(w, v))
        if close and -close[0][0] >= 10 * n:
            forms[w] = close[0][1]
        out[w] = (n, len(close), forms.get(w), words[forms[w]] if w in forms else None)
    for w in out:
        root = w
        while root in forms:
            root = forms[root]
        out[w] += (root,)
    return out


def variants_of(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def spelled(seed):
    """Documents over few letters with runs of equal ones, and words in a chain of falling counts."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(6, 9))) for _ in range(500)]
    docs = [(i, " ".join(rng.choice(words).title() for _ in range(80))) for i in range(30)]
    chain = ["aaaaaaabcdefgh", "aaaaaaabcdefg", "aaaaaabcdefg", "aaaaaabcdefx"]
    return docs + [(100 + k, f"{w} " * 2 * 12 ** (3 - k)) for k, w in enumerate(chain)]


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_as_brute_force(spark, seed):
    docs = spelled(seed)
    want = brute_variants(brute_words(docs))
    assert variants_of(spelling.variants(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))) == want
    assert max(v[1] for v in want.values()) > 3 and any(want[v[2]][2] for v in want.values() if v[2])  # a form of a form


def test_variants_of_edge_cases(edge, edge_docs, empty, spark, monkeypatch):
    assert variants_of(spelling.variants(edge)) == brute_variants(brute_words(edge_docs))
    assert spelling.variants(empty).collect() == []
    docs = [(None, "Überall überall ÜBERALL überalL"), (None, None), (7, "straßen×÷a straßen×÷a"), (7, "straßen×÷a"), (8, "")]
    monkeypatch.setattr(spelling, "WINDOW", 5)
    monkeypatch.setattr(spelling, "HELD", 1)
    assert variants_of(spelling.variants(spark.createDataFrame(docs, "doc_id long, text string"))) == brute_variants(brute_words(docs))


def test_runs_in_windows(monkeypatch):
    rng = random.Random(3)
    low = "".join(rng.choice("aÿ é-") for _ in range(5000)) + "x" * 400
    whole = Counter(re.findall("[a-zÀ-ÿ]{7,}", low))
    for window in (1, 7, 100, 10**6):
        monkeypatch.setattr(spelling, "WINDOW", window)
        got = Counter()
        for run, n in spelling.runs(low):
            got[run] += n
        assert got == whole


# ranked lexical search


def brute_search(docs, items):
    terms = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lowered(t or ""))
    held = [(i, Counter(terms(t))) for i, t, *_ in docs]
    some = [c for _, c in held if c]
    n_docs, total, df = len(some), sum(sum(c.values()) for c in some), Counter(x for c in some for x in c)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for i, c in held:
            m = 75 + 25 * sum(c.values()) * n_docs // total if c else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (1000000000 * c[x] // (1000 * c[x] + 12 * m)) for x in terms(text) if x in c)
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, k, i, -s) for k, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:20], 1)]
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in df.collect()), key=repr)


def texts(n, rng, words):
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for i in range(n)]


@pytest.mark.parametrize("block", [1 << 18, 100])
def test_search_as_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(lexical_search, "BLOCK_CHARS", block)
    monkeypatch.setattr(lexical_search, "CELLS", 200)
    monkeypatch.setattr(lexical_search, "WINDOW", 10)
    rng = random.Random(block)
    words = "The the THE cat-hat hat é Éa l'été x1 1x 日本 日 , ; \x00 a the".split() + [f"w{i}" for i in range(40)]
    docs = texts(300, rng, words) + [(1000 + i, "the cat hat the cat") for i in range(40)] + [(5, None), (None, "cat"), (None, "cat"), (6, "")]
    items = [(i, t) for i, t in texts(25, rng, words)] + [(99, "cat the cat"), (99, "cat the cat"), (98, None), (None, "hat"), (97, "nothing such"), (96, "")]
    got = lexical_search.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(6), spark.createDataFrame(items, "item_id long, text string"))
    assert found(got) == brute_search(docs, items)


def test_search_of_edge_cases(spark, edge, edge_docs, empty):
    items = [(1, "quick brown fox"), (2, "wörd1x1 jumps repeat"), (3, "日本語テキスト日本語テキスト"), (4, "12 tie")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert found(lexical_search.search(edge, asked)) == brute_search(edge_docs, items)
    assert lexical_search.search(empty, asked).collect() == []
    assert lexical_search.search(edge, asked.where("false")).collect() == []


# secret scans

WIDE = "AbC9xYz7KlM3nOp5QrS1"


def brute_base(text):
    spans = []
    for kind, name, pattern, group, least in ((0, "assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), (1, "access", "AKIA[A-Z0-9]+", 0, 20), (2, "hex", "[0-9a-f]+", 0, 24)):
        spans += [(m.start(), kind, m.end(), name, m.group(group)) for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
    return sorted(spans)


def brute_scan(docs):
    rows, seen = [], defaultdict(set)
    random_looking = lambda v: bool(re.search("[0-9]", v) and re.search("[A-Za-z]", v)) and len(set(v)) >= 8
    for i, t, _, source, *_ in docs:
        base = brute_base(t or "")
        more = [(m.start(), 3, m.end(), "live", m.group()) for m in re.finditer("[A-Za-z0-9+/_-]{16,}", t or "") if random_looking(m.group()) and not any(b[0] < m.end() and b[2] > m.start() for b in base)]
        rows.append((i, base, more))
        for s in base + more:
            seen[s[4]].add((source or "", str(i) if i is not None else ""))
    few = {v: len({o for o, _ in at}) <= 2 and len(at) <= 10 for v, at in seen.items()}
    listed = lambda spans: ",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in sorted(spans))
    out = []
    for i, base, more in rows:
        kinds = Counter(s[1] for s in base)
        more = [s for s in more if few[s[4]]]
        live = sum(few[s[4]] and random_looking(s[4]) for s in base + more)
        out.append((i, kinds[0], kinds[1], kinds[2], hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + more), live, sum(not few[s[4]] for s in base)))
    return sorted(out, key=repr)


def scanned(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_copied")) for r in df.collect()), key=repr)


def test_secrets_as_brute_force(spark):
    copied, own = "AKIA" + "Z9X8C7V6B5N4M3L2", "0123456789abcdef01234567"
    docs = [(i, f"😀 key {copied} and x", None, f"s{i % 7}") for i in range(20)]
    docs += [(100, f"Token = '{own}' {WIDE}", None, "a"), (100, f"Token = '{own}' {WIDE}", None, "a"), (101, "token=abc token==secret: abcdefg password=\npasswd : 'xx'", None, "a"), (102, f"API_KEY:{WIDE}-{WIDE} apikey\"= \"q{WIDE}.z", None, None)]
    docs += [(103, "AKIA123 AKIAAKIA" + "B" * 14 + " " + "f" * 24 + " " + "F" * 24 + "é" + "a1" * 12, None, "b"), (104, WIDE, None, "b"), (105, "x" + WIDE + "/é" + "a" * 30, None, "b"), (None, None, None, "b"), (None, "secret: hunter2", None, None), (106, "", None, "c")]
    rng = random.Random(4)
    parts = ["token", "=", " ", ":", '"', "abcdef", "AKIA", "0123456789ABCDEF", "0123456789abcdef", "é", "ſecret", "secret", WIDE, "/", "\n"]
    docs += [(200 + i, "".join(rng.choice(parts) for _ in range(40)), None, f"s{i % 3}") for i in range(200)]
    docs.append((500, " ".join(f"password={rng.getrandbits(80):x}{WIDE} k{rng.getrandbits(99):X}z" for _ in range(3000)), None, "long"))
    got = secret_scan.scan(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(5))
    assert scanned(got) == brute_scan(docs)


def test_secrets_of_edge_cases(edge, edge_docs, empty):
    assert scanned(secret_scan.scan(edge)) == brute_scan(edge_docs)
    assert secret_scan.scan(empty).collect() == []


def test_secrets_run_no_python(spark, edge):
    plan = secret_scan.scan(edge)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
