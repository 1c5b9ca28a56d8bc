"""Top-k retrieval by query likelihood, its filters, feedback vectors and resource selection.

All texts of the query that matter are few, so term statistics are looked up for the query's terms alone; postings are
read by term, which reaches the scan. The one large shuffle is the sum of scores by document.
"""

from __future__ import annotations

from .base import Plan, values

QUERY = (("thing", 1.0), ("ention", 1.0), ("ster", 1.0))
MU = 2500.0
#: Share of the documents in the sample index that selection searches (a collection of its own, with its own statistics).
SAMPLE_RATE = 0.25
NO_REPOST = "retweeted_status_id = 0 AND upper(substr(text, 1, 3)) <> 'RT '"
MOST = 10000
#: The time of a query that names none, where one is needed: after all statuses.
LATEST = 4102444800
#: Weights of ranks, as single-precision constants widened: a fixed value each.
CRCS_ALPHA, CRCS_BETA = 1.2000000476837158, 0.2800000011920929


def time_filter(max_id: int | None = None, epochs: tuple[int, int] | None = None, future: bool = False) -> str:
    """The predicate of a request: the future wins over an id, an id over a range of time; both borders count."""
    if future:
        return "1 = 1"
    if max_id:
        return f"id BETWEEN 0 AND {max_id}"
    if epochs and (epochs[0] > 0 or epochs[1] > 0):
        return f"epoch BETWEEN {epochs[0]} AND {epochs[1]}"
    return "1 = 1"


def sampled(id_: str = "id", rate: float = SAMPLE_RATE) -> str:
    """The sampling operator of the central sample index: documents whose hashed id falls below the rate. It is the same
    for a document wherever it is asked, so that the sample's sizes and its search agree."""
    return f"substr(md5(CAST({id_} AS STRING)), 1, 4) < '{min(round(rate * 65536), 65535):04x}'"


def _quoted(word: str) -> str:
    return "'" + word.replace("'", "''") + "'"


def query(p: Plan, name: str = "q", terms: tuple = QUERY) -> str:
    p.add(name, values([(t, float(w)) for t, w in terms], "term, w"))
    return name


def search(p: Plan, name: str, q: str, limit: int = 1000, where: str = "1 = 1", sample: float = 1.0, reposts: bool = False, terms: tuple | None = QUERY, mu: float = MU, keep: int | None = None) -> str:
    """Adds the steps of a search; the result ``name`` has id, screen_name, text, lang, epoch, ..., rsv and j (its rank).

    sample: the share of documents that the collection has, if not all. keep: another bound than limit for how many are scored again.
    """
    n = f"{mu!r}e0"
    if not terms:
        p.cut(q)
    inside = f"AND term IN ({', '.join(repr(t) for t, _ in terms)})" if terms else f"AND term IN (SELECT term FROM {q})"
    p.add(f"{name}_hit", f"SELECT p.id, p.term, p.tf, p.dl, {q}.w FROM {{postings}} p JOIN {q} ON p.term = {q}.term WHERE {sampled('p.id', sample) if sample < 1 else '1 = 1'} {inside.replace('term IN', 'p.term IN')}")
    p.add(f"{name}_len", f"SELECT id, dl FROM {{doclen}}" + (f" WHERE {sampled('id', sample)}" if sample < 1 else ""))
    if sample >= 1:
        p.add(f"{name}_size", "SELECT CAST(sum_ctf AS DOUBLE) AS c, CAST(num_docs AS DOUBLE) AS n FROM {coll}")
        p.add(f"{name}_df", f"SELECT t.term, t.df, t.ctf FROM {{term_stats}} t JOIN {q} ON t.term = {q}.term{inside.replace('term IN', 't.term IN').replace('AND', ' WHERE', 1)}")
    else:
        p.add(f"{name}_size", f"SELECT CAST(sum(dl) AS DOUBLE) AS c, CAST(count(*) AS DOUBLE) AS n FROM {name}_len")
        p.add(f"{name}_df", f"SELECT term, count(*) AS df, sum(tf) AS ctf FROM {name}_hit GROUP BY term")
    p.add(f"{name}_stat", f"SELECT {q}.term, {q}.w, coalesce(s.df, 0) AS df, coalesce(s.ctf, 0) AS ctf, (coalesce(s.ctf, 0) + 1e0) / (z.c + 1e0) AS p FROM {q} LEFT JOIN {name}_df s ON s.term = {q}.term CROSS JOIN {name}_size z")
    p.add(
        f"{name}_first",
        f"""SELECT h.id, round(sum(greatest(0e0, s.w * (ln(1e0 + h.tf / ({n} * s.p)) + ln({n} / (h.dl + {n}))))), 9) AS score
        FROM {name}_hit h JOIN {name}_stat s ON s.term = h.term GROUP BY h.id""",
    )
    most = min(MOST, 3 * limit)
    if where == "1 = 1":  # nothing to filter by: the best are known before their rows are fetched
        p.add(f"{name}_best", f"SELECT id, score FROM {name}_first ORDER BY score DESC, id DESC LIMIT {most}")
        p.add(f"{name}_top", f"SELECT s.*, f.score FROM {name}_best f JOIN {{statuses}} s ON s.id = f.id")
    else:
        p.add(f"{name}_top", f"SELECT s.*, f.score FROM {name}_first f JOIN {{statuses}} s ON s.id = f.id WHERE {where.replace('id ', 's.id ')} ORDER BY f.score DESC, s.id DESC LIMIT {most}")
    p.add(f"{name}_one", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC) AS copy FROM {name}_top WHERE {'1 = 1' if reposts else NO_REPOST}) x WHERE copy = 1")
    p.add(f"{name}_kept", f"SELECT * FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id DESC) AS i FROM {name}_one) x WHERE i <= {keep or limit}").cut(f"{name}_kept", *([f"{name}_stat"] if sample < 1 else []))
    rescore(p, name, f"{name}_kept", limit, n)
    return name


def rescore(p: Plan, name: str, docs: str, limit: int, n: str) -> None:
    p.add(f"{name}_own", f"SELECT h.id, h.term, h.tf FROM {name}_hit h JOIN {docs} k ON k.id = h.id")  # of all hits those of the few documents
    p.add(
        f"{name}_ql",
        f"""SELECT k.id, round(sum(s.w * ln((coalesce(h.tf, 0) + {n} * s.p) / (l.dl + {n}))), 6) AS rsv
        FROM {docs} k CROSS JOIN {name}_stat s JOIN {name}_len l ON l.id = k.id LEFT JOIN {name}_own h ON h.id = k.id AND h.term = s.term GROUP BY k.id""",
    )
    p.add(name, f"SELECT k.*, y.rsv, row_number() OVER (ORDER BY y.rsv DESC, k.id DESC) AS j FROM {docs} k JOIN {name}_ql y ON y.id = k.id ORDER BY y.rsv DESC, k.id DESC LIMIT {limit}")


# Feature vectors


def query_vector(p: Plan, name: str = "qv", q: str = "q") -> str:
    p.add(name, f"SELECT term, sum(w) / sum(sum(abs(w))) OVER () AS w FROM {q} GROUP BY term")
    return name


def feedback_vector(p: Plan, name: str, docs: str, n_docs: int = 50, n_terms: int = 20, min_len: int = 1, max_len: int = 0, min_df: int = 0, stop: frozenset[str] = frozenset()) -> str:
    """Weights of the terms of the best documents: frequency times the document's probability, times an idf of the
    collection's counts; the n_terms largest, scaled to a sum of 1. Probabilities are taken relative to the largest.
    Noise isn't taken: repost marks, mentions, terms with a slash or beyond ASCII (but for hashtags), stop words, terms of
    a length out of bounds or in fewer than min_df documents."""
    p.add(f"{name}_docs", f"SELECT id, exp(rsv - max(rsv) OVER ()) AS pr FROM {docs} WHERE j <= {n_docs}").cut(f"{name}_docs")
    length = f"length(p.term) >= {min_len}" + (f" AND length(p.term) <= {max_len}" if max_len else "") + (f" AND p.term NOT IN ({', '.join(map(_quoted, sorted(stop)))})" if stop else "")
    length += " AND (substr(p.term, 1, 1) = '#' OR (substr(p.term, 1, 1) <> '@' AND p.term NOT LIKE '%/%' AND bit_length(p.term) = 8 * length(p.term)))"
    p.add(f"{name}_tf", f"SELECT p.term, sum(p.tf * d.pr / p.dl) AS f FROM {name}_docs d JOIN {{vectors}} p ON p.id = d.id WHERE p.id IN (SELECT id FROM {name}_docs) AND {length} AND p.term <> 'rt' GROUP BY p.term")
    p.add(f"{name}_w", f"SELECT t.term, round(t.f * (ln((c.sum_ctf + 1e0) / (s.ctf + 1e0)) + 1e0), 12) AS w FROM {name}_tf t JOIN {{term_stats}} s ON s.term = t.term CROSS JOIN {{coll}} c" + (f" WHERE s.df >= {min_df}" if min_df > 0 else ""))
    return prune(p, name, f"{name}_w", n_terms)


def prune(p: Plan, name: str, vector: str, k: int) -> str:
    p.add(f"{name}_cut", f"SELECT term, w FROM {vector} ORDER BY w DESC, term LIMIT {k}")
    p.add(name, f"SELECT term, w / sum(abs(w)) OVER () AS w FROM {name}_cut")
    return name


def interpolate(p: Plan, name: str, a: str, b: str, weight: float = 0.5, k: int = 20) -> str:
    """weight * a + (1 - weight) * b over both vocabularies, pruned and scaled."""
    p.add(f"{name}_sum", f"SELECT coalesce(x.term, y.term) AS term, round({weight!r}e0 * coalesce(x.w, 0e0) + (1e0 - {weight!r}e0) * coalesce(y.w, 0e0), 12) AS w FROM {a} x FULL OUTER JOIN {b} y ON x.term = y.term")
    return prune(p, name, f"{name}_sum", k)


# Resource selection


def shard_hits(p: Plan, name: str, docs: str, by_topic: bool = False, limit: int = 50) -> str:
    """id, rsv, rank and shard of the best documents; a document of several topics counts for each."""
    if by_topic:
        p.add(name, f"SELECT d.id, d.rsv, d.j, t.topic AS shard FROM {docs} d LEFT JOIN {{topics}} t ON t.source = lower(d.screen_name) WHERE d.j <= {limit}")
    else:
        p.add(name, f"SELECT id, rsv, j, lower(screen_name) AS shard FROM {docs} WHERE j <= {limit}")
    return name


def sizes(p: Plan, by_topic: bool = False, rate: float = SAMPLE_RATE) -> None:
    """shard, s (documents) and c (documents of the sample)."""
    shard = "t.topic" if by_topic else "t.source"
    p.add("sizes", f"SELECT {shard} AS shard, count(*) AS s, sum(CASE WHEN {sampled('l.id', rate)} THEN 1 ELSE 0 END) AS c FROM {{doclen}} l JOIN {{topics}} t ON t.source = lower(l.screen_name) GROUP BY {shard}")


def select(p: Plan, name: str, hits: str, method: str = "ranks", normalize: bool = True, max_col: int = 3, min_ranks: float = 1e-5, by_topic: bool = False, rate: float = SAMPLE_RATE) -> str:
    """shard, score, r (its rank), of hits in a sample of the given rate. An unknown method counts votes."""
    n = f"(SELECT max(j) FROM {hits})"
    exponential = f"{CRCS_ALPHA!r}e0 * exp(-{CRCS_BETA!r}e0 * j)"
    method = method.lower()
    if method == "sizes":
        sizes(p, by_topic, rate)
        p.add(f"{name}_raw", "SELECT shard, CAST(c AS DOUBLE) AS score FROM sizes")
    elif method == "ranks":
        p.add(f"{name}_low", f"SELECT min(rsv) AS low, max(CASE WHEN j = 1 THEN shard END) AS best FROM {hits}")
        p.add(
            f"{name}_raw",
            f"""SELECT h.shard, sum(power(50e0, -greatest(h.j - 1, 1)) * CASE WHEN m.low < 0 THEN h.rsv + abs(m.low) ELSE h.rsv END) AS score
            FROM {hits} h CROSS JOIN {name}_low m WHERE h.shard IS NOT NULL GROUP BY h.shard, m.best HAVING NOT (h.shard = m.best AND count(*) = 1)""",
        )
    else:
        weight = {"crcslin": f"{n} - j", "crcsexp": exponential, "crcslogexp": exponential}.get(method, "1")
        outer = "ln(1e0 + count(*)) * " if method == "crcslogexp" else ""
        p.add(f"{name}_raw", f"SELECT shard, {outer}CAST(sum({weight}) AS DOUBLE) AS score FROM {hits} WHERE shard IS NOT NULL GROUP BY shard")
    if normalize:
        sizes(p, by_topic, rate)
        scale = "" if method == "ranks" else " / greatest(1, max(z.c) OVER ())"
        p.add(f"{name}_norm", f"SELECT r.shard, r.score * z.c / z.s{scale} AS score FROM {name}_raw r JOIN sizes z ON z.shard = r.shard")
    source = f"{name}_norm" if normalize else f"{name}_raw"
    p.add(f"{name}_all", f"SELECT shard, score, row_number() OVER (ORDER BY score DESC, shard) AS r FROM (SELECT shard, round(score, 9) AS score FROM {source}) x")
    least = f" AND score >= {min_ranks!r}" if method == "ranks" else ""
    p.add(name, f"SELECT * FROM {name}_all WHERE r <= {max_col}{least}")
    return name


def within(p: Plan, name: str, docs: str, selected: str | None, limit: int, by_topic: bool = False) -> str:
    """Search results within selected shards, ranked anew. A document comes once for each of its selected topics. The
    filter follows the search's own limit, so fewer than limit may be left."""
    p.cut(docs, *([selected] if selected else []))
    if selected is None:
        p.add(name, f"SELECT *, row_number() OVER (ORDER BY rsv DESC, id DESC) AS k FROM {docs} WHERE j <= {limit}")
    elif by_topic:
        p.add(name, f"SELECT * FROM (SELECT d.*, t.topic, row_number() OVER (ORDER BY d.rsv DESC, d.id DESC, t.topic) AS k FROM {docs} d JOIN {{topics}} t ON t.source = lower(d.screen_name) JOIN {selected} s ON s.shard = t.topic) x WHERE k <= {limit}")
    else:
        p.add(name, f"SELECT * FROM (SELECT d.*, row_number() OVER (ORDER BY d.rsv DESC, d.id DESC) AS k FROM {docs} d WHERE lower(d.screen_name) IN (SELECT shard FROM {selected})) x WHERE k <= {limit}")
    return name


def shard_cost(p: Plan, name: str, q: str, selected: str | None, by_topic: bool = False) -> str:
    """c_r: the postings of the query's terms in the searched shards; a term that a shard lacks counts 1."""
    shard = "t.topic" if by_topic else "t.source"
    p.add(f"{name}_df", f"SELECT {shard} AS shard, p.term, count(*) AS df FROM {{postings}} p JOIN {q} ON {q}.term = p.term JOIN {{topics}} t ON t.source = lower(p.screen_name) GROUP BY {shard}, p.term")
    p.add(f"{name}_shards", f"SELECT DISTINCT {shard.replace('t.', '')} AS shard FROM {{topics}}" if selected is None else f"SELECT shard FROM {selected}")
    p.add(name, f"SELECT CAST(coalesce(sum(coalesce(d.df, 1)), 0) AS BIGINT) AS c_r FROM {name}_shards s CROSS JOIN (SELECT DISTINCT term FROM {q}) x LEFT JOIN {name}_df d ON d.shard = s.shard AND d.term = x.term")
    return name
