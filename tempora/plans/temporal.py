"""Recency, kernel densities over time, and features for learning to rank."""

from __future__ import annotations

from .base import Plan

DAY = 86400.0


def ages(p: Plan, name: str, docs: str, at: int) -> str:
    p.add(name, f"SELECT *, ({at}e0 - epoch) / {DAY!r}e0 AS x FROM {docs}")
    return name


def recency(p: Plan, name: str, docs: str, rate: float = 0.01) -> str:
    """density, and rsv raised by its logarithm, or by -1000 where that isn't finite. The order stays."""
    density = f"CASE WHEN x >= 0 THEN {rate!r}e0 * exp(-{rate!r}e0 * x) ELSE 0e0 END"
    p.add(f"{name}_d", f"SELECT *, {density} AS density FROM {docs}")
    p.add(name, f"SELECT *, rsv + CASE WHEN density > 0 THEN ln(density) ELSE -1000e0 END AS recent FROM {name}_d")
    return name


def weights(p: Plan, name: str, docs: str, kind: str = "score", rsv: str = "rsv", first: int = 1000) -> str:
    """A training sample (x, w): uniform, by score (exp of a negative rsv) or by rank (a rate times exp(-rank))."""
    w = {
        "uniform": "1e0 / count(*) OVER ()",
        "score": f"CASE WHEN {rsv} >= 0 THEN {rsv} ELSE exp({rsv}) END",
        "rank": "(2e0 / (count(*) OVER () + 1e0)) * exp(-CAST(row_number() OVER (ORDER BY rsv DESC, id DESC) - 1 AS DOUBLE))",
    }[kind]
    p.add(name, f"SELECT x, {w} AS w FROM {docs} WHERE j <= {first}")
    return name


def bandwidth(p: Plan, name: str, sample: str, factor: float = 1.06) -> str:
    """h = factor * min(sd, iqr / 1.349) * n^(-1/5); 1 for one point, factor * n^(-1/5) without spread.

    Quartiles stand at (n + 1) q / 100 in the sorted sample, between neighbours in proportion.
    """
    p.add(f"{name}_r", f"SELECT x, row_number() OVER (ORDER BY x) AS rn, count(*) OVER () AS n FROM {sample}")
    at = lambda q: f"greatest(1e0, least(n + 0e0, {q}e0 * (n + 1e0) / 100e0))"
    value = lambda q: f"max(CASE WHEN rn = floor({at(q)}) THEN x END) + max({at(q)} - floor({at(q)})) * (max(CASE WHEN rn = least(n, floor({at(q)}) + 1) THEN x END) - max(CASE WHEN rn = floor({at(q)}) THEN x END))"
    p.add(f"{name}_s", f"SELECT max(n) AS n, coalesce(stddev_samp(x), 0e0) AS sd, ({value(75)}) - ({value(25)}) AS iqr, min(x) AS lo, max(x) AS hi FROM {name}_r")
    p.add(f"{name}_m", f"SELECT n, lo, hi, round(least(sd, iqr / 1.349e0), 12) AS a FROM {name}_s")
    p.add(name, f"SELECT n, lo, hi, CASE WHEN n = 1 THEN 1e0 WHEN a = 0 THEN {factor!r}e0 * power(n + 0e0, -0.2e0) ELSE {factor!r}e0 * a * power(n + 0e0, -0.2e0) END AS h FROM {name}_m")
    return name


def density(p: Plan, name: str, points: str, sample: str, reflect: bool = True, factor: float = 1.06) -> str:
    """The weighted normal-kernel density of each point's x (with id); reflected at the sample's ends if asked for."""
    bandwidth(p, f"{name}_h", sample, factor)
    p.add(f"{name}_w", f"SELECT x, w * count(*) OVER () / sum(w) OVER () AS w FROM {sample}")
    phi = lambda u: f"exp(-0.5e0 * power(({u}) / h.h, 2)) / 2.5066282746310002e0"
    terms = [phi("s.x - d.x"), *([phi("s.x + d.x - 2e0 * h.lo"), phi("s.x + d.x - 2e0 * h.hi")] if reflect else [])]
    p.add(name, f"SELECT d.id, sum(s.w * ({' + '.join(terms)})) / max(h.n * h.h) AS f FROM (SELECT id, x FROM {points}) d CROSS JOIN {name}_w s CROSS JOIN {name}_h h GROUP BY d.id")
    return name


def entity_counts(text: str = "text") -> dict[str, str]:
    """Counts of links, hashtags and mentions by what their removal takes away."""
    marks = lambda c: f"(length({text}) - length(replace({text}, '{c}', '')))"
    return {"n_urls": f"((length({text}) - length(replace(lower({text}), '://', ''))) / 3)", "n_hashtags": marks("#"), "n_mentions": marks("@")}


def features(p: Plan, name: str, docs: str, search: str, shard_sample: str | None, at: int, mu: float = 2500.0, beta: float = 1.0, first: int = 1000, n_shard: str | None = None) -> str:
    """The 21 features of each result. Training weights use the rsv after recency has been added to it."""
    p.cut(docs)
    ages(p, f"{name}_age", docs, at)
    recency(p, f"{name}_rec", f"{name}_age")
    weights(p, f"{name}_s4", f"{name}_rec", "score", "recent", first)
    density(p, f"{name}_k4", f"{name}_rec", f"{name}_s4")
    if shard_sample:
        density(p, f"{name}_k7", f"{name}_rec", shard_sample)
    n = f"{mu!r}e0"
    bm25 = "ln((z.n - s.df + 0.5e0) / (s.df + 0.5e0)) * ((1e0 + 0.1e0) * h.tf) / ((0.1e0 * (1e0 - 0e0) + h.tf) + h.tf)"
    p.add(
        f"{name}_t",
        f"""SELECT k.id, sum(CASE WHEN h.tf > 0 THEN ln((z.n + 1e0) / (s.df + 1e0)) + 1e0 ELSE 0e0 END) AS idf, count(h.tf) AS coord, max(l.dl) AS dl,
        sum(coalesce({bm25}, 0e0)) AS bm25, sum(ln((coalesce(h.tf, 0) + {n} * s.p) / (l.dl + {n}))) AS ql
        FROM {docs} k CROSS JOIN {search}_stat s CROSS JOIN {search}_size z JOIN {search}_len l ON l.id = k.id LEFT JOIN {search}_own h ON h.id = k.id AND h.term = s.term GROUP BY k.id""",
    )
    e = entity_counts("d.text")
    one = lambda x: f"CASE WHEN {x} > 0 THEN 1e0 ELSE 0e0 END"
    seven = f"CASE WHEN (SELECT count(*) FROM {shard_sample}) > 1 THEN coalesce(k7.f, 0e0) ELSE 0e0 END" if shard_sample else "0e0"
    wanted = [
        "exp(d.rsv)", "d.density", "0e0", "coalesce(k4.f, 0e0)", "0e0", "0e0", seven, "t.idf", "t.coord + 0e0", "t.dl + 0e0", f"{e['n_urls']} + 0e0", one(e["n_urls"]), f"{e['n_hashtags']} + 0e0", one(e["n_hashtags"]), f"{e['n_mentions']} + 0e0", one(e["n_mentions"]),
        "CASE WHEN d.in_reply_to_status_id > 0 THEN 1e0 ELSE 0e0 END", "ln(1e0 + d.statuses_count)", "ln(1e0 + d.followers_count)", "t.bm25", "exp(t.ql)",
    ]
    joins = f"JOIN {name}_t t ON t.id = d.id LEFT JOIN {name}_k4 k4 ON k4.id = d.id" + (f" LEFT JOIN {name}_k7 k7 ON k7.id = d.id" if shard_sample else "")
    p.add(name, f"SELECT d.id, d.rsv, {', '.join(f'{x} AS f{i}' for i, x in enumerate(wanted, 1))} FROM {name}_rec d {joins}")
    return name


#: A linear model over features scaled to 0..1 within a result list; a model of one's own takes its place.
LINEAR = {"f1": 0.5, "f2": 1.0, "f4": 0.5, "f8": 0.25, "f9": 0.5, "f18": 0.1, "f19": 0.1, "f20": 0.75, "f21": 1.5}


def rank(p: Plan, name: str, features: str, limit: int = 1000, model: dict[str, float] | None = None) -> str:
    """Results by a linear model. A list has at most 10,000 rows, so a window over all of it is small."""
    model = model or LINEAR
    scaled = " + ".join(f"{w!r}e0 * CASE WHEN max({f}) OVER () > min({f}) OVER () THEN ({f} - min({f}) OVER ()) / (max({f}) OVER () - min({f}) OVER ()) ELSE 0e0 END" for f, w in model.items())
    p.add(f"{name}_m", f"SELECT id, round({scaled}, 6) AS score FROM {features}")
    p.add(name, f"SELECT id, score, row_number() OVER (ORDER BY score DESC, id DESC) AS r FROM {name}_m ORDER BY score DESC, id DESC LIMIT {limit}")
    return name


def mean_tf(docs: str, k: int = 3, how: str = "avg") -> str:
    """Which results' terms come fewer than k times on average (or at most), by what the index knows of each length."""
    return f"SELECT d.* FROM {docs} d JOIN {{doclen}} m ON m.id = d.id WHERE m.dl < {k} * m.dt" if how == "avg" else f"SELECT d.* FROM {docs} d JOIN {{doclen}} m ON m.id = d.id WHERE m.mt < {k}"
