"""DuckDB SQL that recomputes the queries of the catalogue from the same tables.

A statement is a chain of named sub-queries. The builders below add the links one by one,
so that a whole fit can be written out, draw by draw."""

from __future__ import annotations

from collections.abc import Sequence

PI2 = "(2 * pi())"
#: Measures of a line, with factors that make them comparable.
MEASURES = {"l_quantity": 0.1, "l_discount": 10.0, "l_tax": 20.0}


def uniform_sql(*parts: str) -> str:
    """The hash uniform of a key; parts are SQL expressions."""
    key = " || '|' || ".join(f"({part})::VARCHAR" for part in parts)
    return f"(('0x' || substr(md5({key}), 1, 8))::UBIGINT / 4294967296.0)"


def text(value: object) -> str:
    return f"'{value}'"


def r6(expression: str) -> str:
    return f"(round({expression}, 6) + 0.0)"


class Chain:
    """Named sub-queries followed by a final select."""

    def __init__(self) -> None:
        self.links: dict[str, str] = {}

    def add(self, name: str, query: str) -> Chain:
        self.links.setdefault(name, query)
        return self

    def select(self, query: str, inline: Sequence[str] = ()) -> str:
        """``inline`` names links to be expanded where they are used: DuckDB may wait forever
        for a stored table that a link and its own source both read."""
        kind = {name: "NOT MATERIALIZED" for name in inline}
        body = ",\n".join(f"{name} AS {kind.get(name, 'MATERIALIZED')} ({q})" for name, q in self.links.items())
        return f"WITH {body}\n{query}"


# -- the given tables as matrices -------------------------------------------------------


def events_chain() -> Chain:
    """``ev(row_id, col_id, t, x)``: daily sums per user and event type."""
    return (
        Chain()
        .add("ev_names", "SELECT event_type, dense_rank() OVER (ORDER BY event_type) - 1 AS col_id "
             "FROM (SELECT DISTINCT event_type FROM events)")
        .add("ev_n", "SELECT min(ts)::DATE AS first, max(ts)::DATE - min(ts)::DATE + 1 AS n FROM events")
        .add("ev_sums", "SELECT user_id AS row_id, col_id, ts::DATE - first + 1 AS t, sum(value) AS v "
             "FROM events JOIN ev_names USING (event_type), ev_n GROUP BY ALL")
        .add("ev_grid", "SELECT row_id, col_id, unnest(range(1, n + 1)) AS t FROM "
             "(SELECT DISTINCT row_id FROM ev_sums), ev_names, ev_n")
        .add("ev", "SELECT g.row_id, g.col_id, g.t, coalesce(s.v, 0.0) AS x "
             "FROM ev_grid g LEFT JOIN ev_sums s USING (row_id, col_id, t)")
    )


def pairs_chain() -> Chain:
    """``cell(row_id, col_id, f0, f1)``: mean and sd of each event series."""
    return events_chain().add(
        "cell", "SELECT row_id, col_id, avg(x) AS f0, stddev_samp(x) AS f1 FROM ev GROUP BY ALL"
    )


def measures_chain() -> Chain:
    """``cell(row_id, col_id, f0, f1)``: mean and sd of three measures of the lines of each supplier
    and return flag."""
    values = ", ".join(f"({i}, {column} * {factor})" for i, (column, factor) in enumerate(MEASURES.items()))
    return (
        Chain()
        .add("flags", "SELECT l_returnflag, dense_rank() OVER (ORDER BY l_returnflag) - 1 AS flag FROM (SELECT DISTINCT l_returnflag FROM lineitem)")
        .add("cell", f"SELECT l_suppkey AS row_id, flag * {len(MEASURES)} + m AS col_id, avg(v) AS f0, stddev_samp(v) AS f1 "
             f"FROM lineitem JOIN flags USING (l_returnflag), LATERAL (VALUES {values}) x(m, v) GROUP BY ALL")
    )


def supplier_chain() -> Chain:
    """``sb(row_id, col_id, t, x)``: quarterly quantities per supplier and brand."""
    return (
        Chain()
        .add("sb_names", "SELECT p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS col_id "
             "FROM (SELECT DISTINCT p_brand FROM part)")
        .add("sb_n", "SELECT min(q) AS first, max(q) - min(q) + 1 AS n "
             "FROM (SELECT year(l_shipdate) * 4 + quarter(l_shipdate) AS q FROM lineitem)")
        .add("sb_sums", "SELECT l_suppkey AS row_id, col_id, "
             "year(l_shipdate) * 4 + quarter(l_shipdate) - first + 1 AS t, sum(l_quantity) AS v "
             "FROM lineitem JOIN part ON l_partkey = p_partkey JOIN sb_names USING (p_brand), sb_n GROUP BY ALL")
        .add("sb_grid", "SELECT row_id, col_id, unnest(range(1, n + 1)) AS t FROM "
             "(SELECT DISTINCT row_id FROM sb_sums), sb_names, sb_n")
        .add("sb", "SELECT g.row_id, g.col_id, g.t, coalesce(s.v, 0.0) AS x "
             "FROM sb_grid g LEFT JOIN sb_sums s USING (row_id, col_id, t)")
    )


def embedding_chain() -> Chain:
    """``em(row_id, col_id, pos, x)``: slices of eight floats."""
    return Chain().add(
        "em", "SELECT vec_id AS row_id, (i - 1) // 8 AS col_id, (i - 1) % 8 AS pos, "
        "embedding[i]::DOUBLE AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)"
    )


def spectral_chain() -> Chain:
    """All steps from series to features on the event matrix."""
    chain = events_chain()
    chain.add("st", "SELECT row_id, col_id, avg(x) AS m, stddev_samp(x) AS s FROM ev GROUP BY ALL")
    chain.add("zn", "SELECT row_id, col_id, t - 1 AS i, CASE WHEN s > 0.0001 THEN (x - m) / s ELSE 0.0 END AS z "
              "FROM ev JOIN st USING (row_id, col_id)")
    chain.add("ev_bins", "SELECT unnest(range(0, n // 2 + 1)) AS k FROM ev_n")
    chain.add("ft", f"SELECT row_id, col_id, k, sum(z * cos({PI2} * k * i / n)) AS re, "
              f"sum(z * sin({PI2} * k * i / n)) AS im FROM zn, ev_n, ev_bins GROUP BY row_id, col_id, k")
    chain.add("fr", "SELECT row_id, col_id, k, k / (n * 1.0) AS freq FROM st, ev_n, ev_bins")
    chain.add("pg", "SELECT row_id, col_id, k, (re * re + im * im) / n AS power FROM ft, ev_n")
    chain.add("step", "SELECT avg(freq) AS mean_step FROM fr WHERE k = 1")
    chain.add("grid", "SELECT i, i * mean_step AS frequency FROM step, range(0, 30) r(i), "
              "(SELECT max(freq) AS top, min(freq) AS bottom FROM fr) b "
              "WHERE i * mean_step < top - 1e-9 * mean_step AND i * mean_step > bottom + 1e-9 * mean_step")
    chain.add("spot", "SELECT i, row_number() OVER (ORDER BY i) - 1 AS pos, "
              "least(floor(frequency * n)::BIGINT, n // 2 - 1) AS lo, frequency * n AS place FROM grid, ev_n")
    chain.add("ip", "SELECT a.row_id, a.col_id, pos, a.power * (1 - (place - lo)) + b.power * (place - lo) AS v "
              "FROM spot JOIN pg a ON a.k = lo JOIN pg b ON b.k = lo + 1 AND b.row_id = a.row_id AND b.col_id = a.col_id")
    chain.add("lg", "SELECT row_id, col_id, pos, log10(1 + v) AS v FROM ip")
    chain.add("cs", "SELECT row_id, col_id, pos, (v - avg(v) OVER (PARTITION BY pos)) / "
              "stddev_samp(v) OVER (PARTITION BY pos) AS v FROM lg")
    return chain


# -- labels and block models on two features --------------------------------------------


def add_col_labels(chain: Chain, name: str, n_groups: int, seed: int, cells: str = "cell") -> Chain:
    u = uniform_sql(text("c"), "col_id", text(seed))
    return chain.add(name, f"SELECT col_id, (row_number() OVER (ORDER BY {u}, col_id) - 1) % {n_groups} AS l "
                     f"FROM (SELECT DISTINCT col_id FROM {cells})")


def add_row_labels(chain: Chain, name: str, row_clusters: Sequence[int], seed: int, cells: str = "cell") -> Chain:
    u = uniform_sql(text("r"), "row_id", "l", text(seed))
    sizes = ", ".join(f"({l}, {k})" for l, k in enumerate(row_clusters))
    return chain.add(name, f"SELECT row_id, l, (row_number() OVER (PARTITION BY l ORDER BY {u}, row_id) - 1) % g AS k "
                     f"FROM (SELECT DISTINCT row_id FROM {cells}), (VALUES {sizes}) s(l, g)")


def row_join(shared: bool) -> str:
    return "USING (row_id)" if shared else "USING (row_id, l)"


def add_labelled(chain: Chain, name: str, rows: str, cols: str, shared: bool, cells: str = "cell") -> Chain:
    """Cells with their block. Shared row labels carry no l."""
    source = f"(SELECT row_id, k FROM {rows})" if shared else rows
    return chain.add(name, f"SELECT c.row_id, c.col_id, p.l, r.k, f0, f1 FROM {cells} c JOIN {cols} p USING (col_id) "
                     f"JOIN {source} r {row_join(shared)}")


def add_model(chain: Chain, name: str, labelled: str, shared: bool) -> Chain:
    """Estimated blocks ``(l, k, n, m0, m1, c00, c01, c11, row_prop, col_prop)``."""
    per_row = "sum(n) OVER (PARTITION BY k) / sum(n) OVER ()" if shared else "n / sum(n) OVER (PARTITION BY l)"
    return chain.add(name, f"SELECT *, {per_row} AS row_prop, sum(n) OVER (PARTITION BY l) / sum(n) OVER () AS col_prop "
                     "FROM (SELECT l, k, count(*)::DOUBLE AS n, avg(f0) AS m0, avg(f1) AS m1, covar_samp(f0, f0) AS c00, "
                     f"covar_samp(f0, f1) AS c01, covar_samp(f1, f1) AS c11 FROM {labelled} GROUP BY l, k)")


def add_densities(chain: Chain, name: str, model: str, cells: str = "cell") -> Chain:
    """Log density of every cell under every block."""
    return chain.add(name, "SELECT row_id, col_id, l, k, row_prop, col_prop, "
                     "-ln(2 * pi()) - 0.5 * ln(c00 * c11 - c01 * c01) - 0.5 * (c11 * (f0 - m0) * (f0 - m0) "
                     "- 2 * c01 * (f0 - m0) * (f1 - m1) + c00 * (f1 - m1) * (f1 - m1)) / (c00 * c11 - c01 * c01) AS ll "
                     f"FROM {cells}, {model}")


def add_row_scores(chain: Chain, name: str, densities: str, cols: str, shared: bool) -> Chain:
    group = "0 AS l" if shared else "l"
    keys = "row_id, k" if shared else "row_id, l, k"
    return chain.add(name, f"SELECT row_id, {group}, k, sum(ll) + ln(any_value(row_prop)) AS score "
                     f"FROM {densities} SEMI JOIN {cols} USING (col_id, l) GROUP BY {keys}")


def add_col_scores(chain: Chain, name: str, densities: str, rows: str, shared: bool) -> Chain:
    source = f"(SELECT row_id, k FROM {rows}) USING (row_id, k)" if shared else f"{rows} USING (row_id, l, k)"
    return chain.add(name, "SELECT col_id, l, sum(ll) + ln(any_value(col_prop)) AS score "
                     f"FROM {densities} SEMI JOIN {source} GROUP BY col_id, l")


def draw(scores: str, keys: str, label: str, u: str) -> str:
    """Index of the first category whose running weight reaches u times the total."""
    return (
        f"SELECT {keys}, sum(CASE WHEN running < {u} * total AND {label} < top THEN 1 ELSE 0 END)::BIGINT AS {label} FROM ("
        f"SELECT *, sum(w) OVER (PARTITION BY {keys} ORDER BY {label}) AS running, "
        f"sum(w) OVER (PARTITION BY {keys}) AS total, max({label}) OVER (PARTITION BY {keys}) AS top FROM ("
        f"SELECT *, exp(score - max(score) OVER (PARTITION BY {keys})) AS w FROM {scores})) GROUP BY {keys}"
    )


def add_row_draw(chain: Chain, name: str, scores: str, iteration: int, sweep: int, seed: int) -> Chain:
    u = uniform_sql(text("d"), "row_id", "l", text(iteration), text(sweep), text(seed))
    return chain.add(name, draw(scores, "row_id, l", "k", u))


def add_col_draw(chain: Chain, name: str, scores: str, iteration: int, sweep: int, seed: int) -> Chain:
    u = uniform_sql(text("e"), "col_id", text(iteration), text(sweep), text(seed))
    return chain.add(name, draw(scores, "col_id", "l", u))


def add_cols_from_proportions(chain: Chain, name: str, n_groups: int, seed: int, cells: str = "cell") -> Chain:
    """Columns drawn from uniform proportions."""
    u = uniform_sql(text("e"), "col_id", text(0), text(0), text(seed))
    return chain.add(name, f"SELECT col_id, greatest(ceil({u} * {n_groups}) - 1, 0)::BIGINT AS l "
                     f"FROM (SELECT DISTINCT col_id FROM {cells})")


def add_sweeps(chain: Chain, tag: str, densities: str, cols: str, shared: bool,
               iteration: int, seed: int, sweeps: int = 3) -> tuple[str, str]:
    rows = ""
    for sweep in range(1, sweeps + 1):
        here = f"{tag}_{sweep}"
        add_row_scores(chain, f"rs{here}", densities, cols, shared)
        rows = f"r{here}"
        add_row_draw(chain, rows, f"rs{here}", iteration, sweep, seed)
        add_col_scores(chain, f"cs{here}", densities, rows, shared)
        cols = f"p{here}"
        add_col_draw(chain, cols, f"cs{here}", iteration, sweep, seed)
    return rows, cols


def add_likelihood(chain: Chain, name: str, densities: str, rows: str, cols: str, shared: bool) -> Chain:
    source = f"(SELECT row_id, k FROM {rows}) USING (row_id, k)" if shared else f"{rows} USING (row_id, l, k)"
    return chain.add(name, f"SELECT sum(ll) AS loglik FROM {densities} SEMI JOIN {cols} USING (col_id, l) SEMI JOIN {source}")


def add_fit(chain: Chain, tag: str, model: str, cols: str, shared: bool, iterations: int, seed: int,
            cells: str = "cell") -> tuple[list[str], str, str]:
    """A fit written out: names of the likelihoods, the last rows and the last columns."""
    add_densities(chain, f"d{tag}_0", model, cells)
    add_row_scores(chain, f"rs{tag}_00", f"d{tag}_0", cols, shared)
    rows = f"r{tag}_00"
    add_row_draw(chain, rows, f"rs{tag}_00", 0, 0, seed)
    add_likelihood(chain, f"k{tag}_0", f"d{tag}_0", rows, cols, shared)
    likelihoods = [f"k{tag}_0"]
    for it in range(1, iterations + 1):
        rows, cols = add_sweeps(chain, f"{tag}_{it}", f"d{tag}_{it - 1}", cols, shared, it, seed)
        add_labelled(chain, f"b{tag}_{it}", rows, cols, shared, cells)
        add_model(chain, f"m{tag}_{it}", f"b{tag}_{it}", shared)
        add_densities(chain, f"d{tag}_{it}", f"m{tag}_{it}", cells)
        add_likelihood(chain, f"k{tag}_{it}", f"d{tag}_{it}", rows, cols, shared)
        likelihoods.append(f"k{tag}_{it}")
    return likelihoods, rows, cols


def add_sampled_model(chain: Chain, name: str, row_clusters: Sequence[int], m: int, seed: int, cells: str = "cell") -> Chain:
    """Blocks from ``m`` sampled rows each and one random column of every row."""
    blocks = ", ".join(f"({l}, {k}, {size})" for l, size in enumerate(row_clusters) for k in range(size))
    by_row = uniform_sql(text("b"), "row_id", "l", "k", text(seed))
    by_col = uniform_sql(text("s"), "row_id", "col_id", "l", "k", text(seed))
    chain.add(f"{name}_rows", f"SELECT * FROM (SELECT row_id, l, k, size, row_number() OVER (PARTITION BY l, k ORDER BY {by_row}, row_id) AS place "
              f"FROM (SELECT DISTINCT row_id FROM {cells}), (VALUES {blocks}) s(l, k, size)) WHERE place <= {m}")
    chain.add(f"{name}_cells", f"SELECT * FROM (SELECT r.row_id, r.l, r.k, r.size, f0, f1, row_number() OVER (PARTITION BY r.l, r.k, r.row_id ORDER BY {by_col}, col_id) AS pick "
              f"FROM {name}_rows r JOIN {cells} USING (row_id)) WHERE pick = 1")
    return chain.add(name, "SELECT l, k, avg(f0) AS m0, avg(f1) AS m1, covar_samp(f0, f0) AS c00, covar_samp(f0, f1) AS c01, "
                     f"covar_samp(f1, f1) AS c11, 1.0 / any_value(size) AS row_prop, 1.0 / {len(row_clusters)} AS col_prop FROM {name}_cells GROUP BY l, k")


def add_pooled_axes(chain: Chain) -> Chain:
    """Principal axes of two features in closed form: ``axes(i, w0, w1, share)``, each with
    its largest entry positive."""
    chain.add("pc", "SELECT covar_samp(f0, f0) AS a, covar_samp(f0, f1) AS b, covar_samp(f1, f1) AS c FROM cell")
    chain.add("ev1", "SELECT *, (a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b) AS big, "
              "(a + c) / 2 - sqrt((a - c) * (a - c) / 4 + b * b) AS low FROM pc")
    chain.add("dir", "SELECT *, b / sqrt(b * b + (big - a) * (big - a)) AS x, (big - a) / sqrt(b * b + (big - a) * (big - a)) AS y FROM ev1")
    return chain.add("axes", "SELECT i, w0 * sign(CASE WHEN abs(w0) >= abs(w1) THEN w0 ELSE w1 END) AS w0, "
                     "w1 * sign(CASE WHEN abs(w0) >= abs(w1) THEN w0 ELSE w1 END) AS w1, share FROM ("
                     "SELECT 0 AS i, x AS w0, y AS w1, big / (big + low) AS share FROM dir UNION ALL "
                     "SELECT 1, -y, x, low / (big + low) FROM dir)")
