"""The operators on Spark: against brute force, and on nulls, empty and long texts, ties, repeated rows, no rows and
columns of clashing names."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tempora.llm import fingerprint, jaccard, mixing, packing, pii, quality, rules, shared, suffix, units, warc
from tempora.llm.oracles import ORACLES
from tempora.llm.queries import QUERIES, tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, piece string, class_id string, digest long, removed int, label int, n_words int, score string, part int, mark int"


def _rows(n=60, seed=4):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(600)] + ["é", "ß,"]
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k)) + "\n" * rng.randint(0, 2)
    passages = [prose(rng.randint(40, 80)) for _ in range(4)]
    out = []
    for i in range(n):
        text = prose(rng.randint(0, 150))
        for _ in range(rng.randint(0, 2)):
            text += rng.choice(passages)[rng.randint(0, 20) :] + prose(rng.randint(0, 30))
        out.append((i * 3, text, rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", "Z", None])))
    base = out[5][1].split(" ")
    for k in range(6):
        near = list(base)
        near[rng.randrange(len(near))] = f"z{k}"
        out.append((500 + k, " ".join(near), "en", "s0"))
    out += [(600, out[0][1], "en", "s0"), (600, out[0][1], "en", "s0"), (601, "", "en", "s1"), (602, None, None, None), (None, "no id " + prose(30), "en", "s0"), (603, "long word " * 30_000, "en", "s2"), (604, "x" * 150_000, "en", "s2"), (605, "ab" * 300, "en", "s2")]
    return out


def _frame(spark, found):
    return spark.createDataFrame([(*r, len(r[1] or ""), 1, "p", "c", 2, 3, 4, 5, "s", 6, 7) for r in found], SCHEMA)


@pytest.fixture(scope="module")
def found():
    return _rows()


@pytest.fixture(scope="module")
def docs(spark, found):
    return _frame(spark, found).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _removed(found, w):
    seen = defaultdict(int)
    raw = [(i, (t or "").encode()) for i, t, *_ in found]
    for _, b in raw:
        for k in range(len(b) - w + 1):
            seen[b[k : k + w]] += 1
    out = []
    for i, b in raw:
        gone, last = bytearray(len(b)), 0
        for k in range(len(b) - w + 1):
            if seen[b[k : k + w]] > 1:
                for q in range(max(k, last), k + w):
                    gone[q] = 1
                last = k + w
        out.append((i, len(b), sum(gone), bytes(c for c, g in zip(b, gone) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [suffix.MAX_FRAGMENTS, 1])
def test_suffix_dedup(spark, limit):
    some = [r if r[0] not in (603, 604) else (r[0], r[1][:3000], *r[2:]) for r in _rows()]
    got = suffix.dedup(_frame(spark, some).repartition(2), max_fragments=limit).collect()
    assert sorted(((r.doc_id, r.n_bytes, sum(s["end"] - s["start"] for s in r.removed), bytes(r.kept)) for r in got), key=str) == _removed(some, 200)


def test_suffix_long(spark, docs, monkeypatch):
    monkeypatch.setattr(suffix, "_PIECE", 1000)
    data = np.frombuffer(("abc " * 2000).encode() + bytes(range(256)) * 8, np.uint8)
    whole = suffix.cut(data, np.array([0, len(data)]))
    parts = list(suffix._pieces(data, np.array([0, len(data)]), 200))
    assert sum(p[4].sum() for p in parts) == whole[4].sum() == len(data) - 199


def _thue_morse(n):
    """Two complementary texts that polynomials modulo 2**64 don't tell apart."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[k] for k in bits), "".join("ba"[k] for k in bits)


def test_hashes_tell_texts_apart(spark):
    from tempora.llm.textvec import Words, chunked

    one, two = _thue_morse(4096)
    lanes, bins = fingerprint.sums(pa.array([one, two, one]))
    assert (lanes[0] != lanes[1]).all() and (lanes[0] == lanes[2]).all() and (bins[0] != bins[1]).any()
    _, _, data, at = next(chunked(pa.array([one, two])))
    assert len(set(Words(data, at).hashes(data).tolist())) == 2
    runs = [" ".join({"a": "aaaa", "b": "bbbb"}[c] for c in t) for t in (one, two)]
    got = units.dedup(spark.createDataFrame([*enumerate(runs), (2, runs[0])], "doc_id long, text string")).collect()
    assert {r.doc_id: len(r.removed) for r in got} == {0: 0, 1: 0, 2: 1}


def _graph(found, t=0.8):
    sets = {}
    for n, (i, text, *_) in enumerate(found):
        w = WORD.findall(text or "")
        sets[n] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    up, links = {n: n for n in sets}, dict.fromkeys(sets, 0)

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in itertools.combinations(sets, 2):
        union = len(sets[a] | sets[b])
        if (len(sets[a] & sets[b]) / union if union else 1) >= t:
            links[a] += 1
            links[b] += 1
            up[root(b)] = root(a)
    groups = defaultdict(list)
    least = -(1 << 63)
    ids = [least if r[0] is None else r[0] for r in found]
    for n in sets:
        groups[root(n)].append(ids[n])
    return sorted((ids[n], min(groups[root(n)]), links[n]) for n in sets)


@pytest.mark.parametrize(("block", "bucket"), [(512, 4096), (3, 2)])
def test_jaccard(docs, found, monkeypatch, block, bucket):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "MAX_BUCKET", bucket)
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard.join(docs).collect()) == _graph(found)


def test_pipeline_keeps_texts_of_a_repeated_id(spark):
    import corpus_pipeline

    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    rows = spark.createDataFrame([(1, a, "en", "s", 1), (5, a, "en", "s", 1), (5, b, "en", "s", 1), (5, b, "en", "s", 1), (None, "c " + a[::-1], "en", "s", 1), (None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates_stage(spark, rows, "").collect()
    assert sorted((str(r.doc_id), (r.text or "")[:2]) for r in kept) == [("1", "a0"), ("5", "b0"), ("None", ""), ("None", "c ")]


def test_jaccard_tells_long_words_apart(spark):
    one, two = _thue_morse(4096)
    rows = spark.createDataFrame([(1, one), (2, two), (3, one)], "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard.join(rows).collect()) == [(1, 1, 1), (2, 2, 0), (3, 1, 1)]


def _phrase_runs(text, least=25):
    """(start, end, words) of the runs of a text, one word at a time."""
    words = [(m.start(), m.end(), m[0].lower()) for m in WORD.finditer(text)]
    ends = [w[-1] in ",;:.!?" or k + 1 == len(words) or "\n" in text[b : words[k + 1][0]] for k, (_, b, w) in enumerate(words)]
    cuts, begin = list(ends), 0
    for k, end in enumerate(ends):
        if end:
            if k + 1 - begin > 12:
                for q in range(begin, k):
                    cuts[q] = len(words[q][2]) <= 3
            begin = k + 1
    out = []
    for k in range(len(words)):
        if (not k or cuts[k - 1]) and (z := next((z for z in range(k + least - 1, len(words)) if cuts[z]), None)) is not None:
            out.append((words[k][0], words[z][1], tuple(w for *_, w in words[k : z + 1])))
    return out


def _kept(text, gone):
    left = "".join(c for k, c in enumerate(text) if not any(a <= k < b for a, b in gone))
    return re.sub(r"\s+", " ", left)


def test_units(docs, found):
    some = [(i, t) for i, t, *_ in found if i != 603]
    first, runs = {}, {}
    for i, text in sorted(some, key=lambda r: (r[0] is None, r[0] or 0)):
        runs[i] = _phrase_runs(text or "")
        for _, _, form in runs[i]:
            first.setdefault(form, i)
    got = {r.doc_id: r for r in units.dedup(docs.where("doc_id is null or doc_id <> 603")).collect()}
    removed = 0
    for i, text in some:
        seen, gone = set(), []
        for a, b, form in runs[i]:
            if form in seen or first[form] != i:
                gone.append((a, b))
            seen.add(form)
        r, text = got[i], text or ""
        assert r.n_units == len(runs[i]) and [k for s in r.removed for k in range(s.start, s.end) if not text[k].isspace()] == sorted({k for a, b in gone for k in range(a, b) if not text[k].isspace()})
        assert _kept(text, gone) == re.sub(r"\s+", " ", r.kept_text or "") and (r.removed or r.kept_text == dict(some)[i])
        removed += len(gone)
    assert removed > 50 and got[602].kept_text is None and got[601].n_units == 0
    long = units.dedup(docs.where("doc_id = 603")).first()
    assert long.n_units == 1 and not long.removed  # words of four letters without marks: one phrase


#: Lines of five words or more.
LINES = r"""
        WITH u AS (
            SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS unit, unnest(string_split(coalesce(text, ''), chr(10))) AS line
            FROM documents
        ), p AS (
            SELECT *, CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY unit) - length(line) - 1 AS BIGINT) AS start,
                   lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) AS form
            FROM u
        ), g AS (
            SELECT *, CASE WHEN form <> '' AND length(form) - length(replace(form, ' ', '')) >= 4
                           THEN row_number() OVER (PARTITION BY form ORDER BY doc_id, unit) > 1 ELSE false END AS gone
            FROM p
        ), d AS (
            SELECT doc_id, count(*) AS n_units, count(*) FILTER (gone) AS n_removed, max(unit) AS top,
                   coalesce(string_agg(start || ':' || (start + length(line)), ',' ORDER BY unit) FILTER (gone), '') AS removed,
                   coalesce(string_agg(line, chr(10) ORDER BY unit) FILTER (NOT gone), '') AS kept,
                   count(*) FILTER (NOT gone) AS n_kept, max(unit) FILTER (NOT gone) AS last_kept
            FROM g GROUP BY doc_id
        )
        SELECT d.doc_id, CASE WHEN coalesce(x.text, '') = '' THEN 0 ELSE n_units END AS n_units, n_removed, removed,
               sha256(CASE WHEN n_kept > 0 AND last_kept < top THEN kept || chr(10) ELSE kept END) AS kept_sha256
        FROM d JOIN documents x USING (doc_id)
    """


def test_lines_equal_sql(spark, sf_dir, duck):
    from conftest import rows
    from pyspark.sql import functions as F

    joined = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    got = units.dedup(shared.table(spark, sf_dir, "documents"), unit="line").select("doc_id", F.size("removed").cast("bigint").alias("n_removed"), joined.alias("removed"), F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
    assert rows(got.toPandas()) == rows(duck.execute(LINES).fetchdf().drop(columns=["n_units"]))
    few = spark.createDataFrame([(1, "one two three\nfour five\n\nx"), (2, "a\n\nOne  two three\nfour five \n"), (2, "a\n\nOne  two three\nfour five \n"), (None, None)], "doc_id long, text string")
    cut = [[(s.start, s.end) for s in r.removed] for r in units.dedup(few, unit="paragraph").orderBy("doc_id").collect()]
    assert cut == [[], [], [(3, 28)], [(3, 28)]]


def test_passages_within_lines(spark):
    passage = "".join(f"Word{k} goes on to say more, and so on. " for k in range(8))
    plain = " ".join(f"stretch{k} of words{k} to" for k in range(20))
    texts = ["Alone at first, " + passage + "then ends", "Other lead, " + passage.lower().replace(" on. ", " on.\n") + "other end", passage[3:40] + "short", "here it is " + plain + " end", "here that was " + plain + " and more"]
    rows = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)] + [(9, None, "en", "s")], "doc_id long, text string, lang string, source string")
    assert all(not r.removed for r in units.dedup(rows, unit="line").collect())
    got = {r.doc_id: r for r in units.dedup(rows).collect()}
    assert not got[0].removed and got[0].kept_text == texts[0] and not got[2].removed and got[9].kept_text is None and not got[3].removed
    for k, (lead, end) in {1: ("Other lead,", "other end"), 4: ("here that", "and more")}.items():
        assert len(got[k].removed) == 1
        a, b = got[k].removed[0]
        assert len(lead) <= a <= len(lead) + 25 and len(texts[k]) - len(end) - 12 <= b <= len(texts[k]) - len(end) and got[k].kept_text == texts[k][:a] + texts[k][b:]


def test_rows_of_one_id_keep_their_own(spark):
    one, two = (" ".join(f"{x}{k}," for k in range(30)) for x in "ab")
    rows = spark.createDataFrame([(1, one), (2, two + " " + one), (2, one + " " + two)], "doc_id long, text string")
    got = sorted((r.kept_text.split()[0][0], len(r.removed)) for r in units.dedup(rows).where("doc_id = 2").collect())
    assert got == [("b", 1), ("b", 1)]


def test_fingerprint(docs, found):
    got = fingerprint.edit_check(docs).collect()
    order = sorted(((i, t or "") for i, t, *_ in found), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = sorted((i, len(t), hashlib.sha256(fingerprint.edited(t, n).encode()).hexdigest()) for (i, t), (_, n) in zip([((-1 if i is None else i), t) for i, t in order], [*order[1:], order[0]]))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    by = defaultdict(set)
    for r in got:
        by[next(t for i, t, *_ in found if i == r.doc_id) or ""].add(r.fingerprint)
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)


def test_mixing(docs, found):
    got = mixing.mix(docs, block=16).collect()
    assert len(got) == len(found) and sorted(r.size for r in got) == sorted(len(WORD.findall(t or "")) for _, t, *_ in found)
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    per = defaultdict(lambda: [0, 0, 0])
    for r in got:
        per[r.source][0] += r.size
        per[r.source][1] += r.taken
        per[r.source][2] = r.target
    names = sorted(per, key=lambda s: (s is None, s or ""))
    targets = mixing.water_fill([per[s][0] for s in names], [1 + k % 3 for k in range(len(names))])
    assert [per[s][2] for s in names] == pytest.approx(targets)
    assert all(abs(per[s][1] - per[s][2]) <= 100 for s in names)
    again = {(r.doc_id, r.size, r.taken) for r in mixing.mix(docs.repartition(5), block=16).collect()}
    assert again == {(r.doc_id, r.size, r.taken) for r in got}
    made = mixing.realise(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), mixing.mix(docs.where("doc_id is not null").dropDuplicates(["doc_id"])))
    assert sum(len(WORD.findall(r.text)) for r in made.collect()) == sum(r.taken for r in mixing.mix(docs.where("doc_id is not null").dropDuplicates(["doc_id"])).collect())


def test_realise_gives_chosen_blocks(spark):
    rows = [(k, " ".join(f"d{k}w{i}" for i in range(2000)), "en", "s0" if k % 2 else "s1") for k in range(12)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    mixed = mixing.mix(frame, block=64)
    plan, made = {r.doc_id: r for r in mixed.collect()}, defaultdict(list)
    for r in mixing.realise(frame, mixed).collect():
        made[r.doc_id] += [int(w.split("w")[1]) for w in r.text.split()]
    for k, r in plan.items():
        assert sum(b - a for a, b in r.ranges) + r.passes * r.size == r.taken == len(made[k])
        assert sorted(made[k]) == sorted([i for a, b in r.ranges for i in range(a, b)] + list(range(2000)) * r.passes)
    part = [r for r in plan.values() if 0 < sum(b - a for a, b in r.ranges) < r.size]
    assert part and all(max(b for _, b in r.ranges) > 1800 and sum(b - a for a, b in r.ranges) < 1800 for r in part)


def test_packing(docs, found):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    got = packing.pack_documents(docs, tokenizer_path()).collect()
    want = []
    for i, text, *_ in found:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        want += [(str(i), p, s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes())) for p, s in enumerate(range(0, len(ids), 2048))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(bins) <= sum(r.length for r in got) / 2048 * 1.02 + 1


def test_encoder(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "CACHE", 20_000)
    monkeypatch.setattr(packing, "_LATE", 300)
    t, e, rng = Tokenizer.from_file(tokenizer_path()), packing.Encoder(tokenizer_path()), random.Random(5)
    letters = "eeABaé bZ.,!'<|>endoftext#1²  ́\n:?sß$%ΣİΑ\x1c\x85 -;×÷É9"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 25))) + rng.choice(["", "", "don't <|endoftext|>! Café. Á", " <|ENDOFTEXT|>, <|endoftext|>.", " it's, é. ×, ÷! É?.,: 9. 9.5, ABC...!!?? (x). x)."]) for _ in range(6000)]
    for i in range(0, len(texts), 500):
        some = texts[i : i + 500]
        for first, last, ids, edge in e(pa.array(some)):
            for k in range(last - first):
                assert ids[edge[k] : edge[k + 1]].tolist() == t.encode(some[first + k], add_special_tokens=False).ids, some[first + k]
    assert e.size <= 20_000 and [x[0].tolist() for x in e.known] == [sorted(x[0].tolist()) for x in e.known]


def test_rules(docs, found):
    got = rules.judge(docs, min_group=3).collect()
    assert len(got) == len(found)
    by = {r.doc_id: r for r in got}
    assert by[602].n_words == by[601].n_words == 0 and by[601].base_failed and not by[601].kept
    assert by[603].base_failed and by[603].n_repeat_words == 60_000 and by[604].base_failed and by[604].word_chars == 150_000
    assert all(not r.kept for r in got if r.base_failed)


def test_fences_follow_groups(spark):
    rng = random.Random(3)
    prose = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(n))
    rows = [(k, "\n".join(prose(12) for _ in range(6)) + " #" * (k % 3 if k < 100 else 0), "en", "marks" if k < 100 else "plain") for k in range(200)]
    rows += [(201, prose(100) + " #1 #2 #3 #4 #5 #6", "en", "plain"), (202, prose(100) + " #1 #2 #3 #4 #5 #6", "en", "marks")]
    got = {r.doc_id: r.reason for r in rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[k] is None for k in range(200)) and got[201] == "symbol_share" and got[202] is None
    lines = [prose(12) for _ in range(60)]
    own = spark.createDataFrame([*rows, (203, "\n".join([*lines, *[x[:3] for x in lines for _ in (0, 1)]]), "en", "plain")], "doc_id long, text string, lang string, source string")
    assert {r.doc_id: r.reason for r in rules.judge(own).collect()}[203] == "dup_line_share"


def test_sketches_merge(spark):
    values = [0, 1, 5, 31, 32, 33, 100, 1000, 12345, 10**6]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for r in df.select("v", rules.least(rules.bucket(df.v)).alias("low")).collect():
        assert r.low <= r.v <= r.low * 17 / 16 + 1
    rows = spark.createDataFrame([("a", "x", v) for v in range(1000)], "lang string, source string, v long")
    whole = rules.sketch(rows, measures=("v",))
    halves = rules.merge(rules.sketch(rows.where("v < 500"), measures=("v",)).unionAll(rules.sketch(rows.where("v >= 500"), measures=("v",))), ("lang", "source"))
    assert sorted(map(tuple, whole.select("bucket", "n").collect())) == sorted(map(tuple, halves.select("bucket", "n").collect()))
    q = rules.quantiles(whole, ("lang", "source"), {"m": 0.5}).first()
    assert 460 <= q.m <= 500 and q.total == 1000


def test_pii(docs, found):
    got = {r.doc_id: r for r in pii.find_spans(docs, redacted=True).collect()}
    assert got[602].spans == [] and got[602].redacted is None and got[601].redacted == ""
    assert all(got[i].spans == [] and got[i].redacted == t for i, t, *_ in found)


def test_pii_of_planted_rows(docs, spark, found):
    from test_plain import _scan

    own = ["mail a.b+c@x-y.example.org now", "é 10.0.0.255, 300.1.1.1 and " + "0" * 5000 + ".1.1.1", "card 4111 1111 1111 1111, +44 (20) 7946-0958", "Token: abcdefghijklmnop1234", None, "a@b.c " * 20_000]
    rows = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(own + own)], "doc_id long, text string, spans int, redacted string")
    got = pii.find_spans(rows).collect()
    assert len(got) == 12 and all([(s.kind, s.start, s.end) for s in r.spans if s.kind in pii.BASE_KINDS] == _scan(own[r.doc_id % 6] or "") for r in got)
    assert {s.kind for r in got for s in r.spans} == {"email", "ip", "card", "phone", "secret"}


def test_warc(spark, tmp_path):
    raw = [(1, "u", b"x" * 200), (2, "a\r\nb", b"x" * 200), (3, None, None), (4, "u", b""), (5, "u", bytes(range(256)) * 700), (6, "u", b"WARC/1.1\r\n\r\nWARC/1.1\r\n" * 5), (7, "u", b"\r\n\r\nWARC/1.1"), (None, "q", b"abc"), (9, "é", b"abc"), (10, "v", b"x" * 200), (11, "http://h/" + "a" * 70_000, b"long address" * 20)]
    df = spark.createDataFrame(raw, "record_id long, uri string, payload binary")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "3")
    warc.write(warc.with_types(df), str(tmp_path / "w"), chunk=1000)
    spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    held, last = defaultdict(bytes), {}
    for r in warc.read_chunks(spark, str(tmp_path / "w")).collect():
        held[r.record_id] += bytes(r.data)
        assert r.sha256_so_far == hashlib.sha256(held[r.record_id]).hexdigest()
        if r["last"]:
            last[r.record_id] = r
    for i, _, body in raw:
        key, body = None if i is None else str(i), body or b""
        assert last[key].payload_digest == hashlib.sha256(body).hexdigest() and last[key].payload_bytes == len(body)
        assert (last[key].record_type, last[key].refers_to) == (("revisit", "1") if i in (2, 10) else ("response", None))
        assert held[key] == (b"" if i in (2, 10) else body)


def test_quality(spark, sf_dir):
    docs, labels = shared.table(spark, sf_dir.replace("0.001", "0.01"), "documents"), shared.table(spark, sf_dir.replace("0.001", "0.01"), "labels")
    model = quality.train(docs, labels)
    scored = quality.score(docs, model).toPandas().merge(labels.toPandas(), on="doc_id")
    scored["held"] = [zlib.crc32(str(i).encode()) % 5 == 0 for i in scored.doc_id]
    test = scored[scored.held]
    assert ((test.score >= 0.3) == (test.quality == 1)).mean() > 0.95
    again = quality.score(docs, quality.train(docs.repartition(7), labels)).toPandas().sort_values("doc_id")
    assert np.allclose(again.score, quality.score(docs, model).toPandas().sort_values("doc_id").score)
    # Texts of over 500,000 words, nearly as many pairs of them distinct, still tell by what they hold.
    rng, kinds = random.Random(8), {k: [w for r in docs.join(labels.where(f"quality = {k}"), "doc_id").select("text").collect() for w in WORD.findall(r.text)] for k in (0, 1)}
    long = [(k, " ".join(w for _ in range(600_000 // len(own) + 1) for w in rng.sample(own, len(own)))) for k, own in kinds.items()]
    assert all(len(set(zip(t.split(" "), t.split(" ")[1:]))) > 100_000 for _, t in long)
    assert {r.doc_id: r.score >= 0.3 for r in quality.score(spark.createDataFrame(long, "doc_id long, text string"), model).collect()} == {0: False, 1: True}
    assert len(model.weights) > 1 << quality.LEAST_BITS and len(quality.train(docs, labels, most_bits=18).weights) == 1 << 18
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "x")], "doc_id long, text string")
    assert all(0 <= r.score <= 1 for r in quality.score(odd, model).collect())
    one = quality.train(docs, labels.where("quality = 1"))
    assert {round(r.score, 3) for r in quality.score(odd, one).collect()} == {1.0}
    assert {r.score for r in quality.score(odd, quality.train(docs, labels.where("1 = 0"))).collect()} == {0.5}


def test_no_rows(spark, none, tmp_path):
    assert suffix.dedup(none).count() == jaccard.join(none).count() == units.dedup(none).count() == fingerprint.edit_check(none).count() == 0
    assert mixing.mix(none).count() == packing.pack_documents(none, tokenizer_path()).count() == rules.judge(none).count() == pii.find_spans(none).count() == 0
    empty = spark.createDataFrame([], "record_id long, uri string, payload binary")
    warc.write(warc.with_types(empty), str(tmp_path / "w"))
    assert warc.records(warc.read_chunks(spark, str(tmp_path / "w"))).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_sql(spark, sf_dir, duck, name):
    from conftest import rows

    assert rows(QUERIES[name](spark, sf_dir).toPandas()) == rows(duck.execute(ORACLES[name]).fetchdf())


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "pii", "mixing", "packing"]
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in corpus_pipeline.STAGES:
        after = shared.written(stage(spark, docs, sf_dir), name)
        if name != "packing":
            assert after.columns == docs.columns and after.count() > 0
        if name == "near_duplicates":
            assert all(r.n_links == 0 for r in jaccard.join(after).collect())
        if name == "pii":
            assert pii.find_spans(after).where("size(spans) > 0").count() == 0
        docs = after
    assert docs.groupBy("sequence_id").agg({"length": "sum"}).agg({"sum(length)": "max"}).first()[0] <= 2048
