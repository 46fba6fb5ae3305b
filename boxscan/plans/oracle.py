"""SQL twins of the registered queries, written for DuckDB over the same tables.

They follow the definitions directly (row by row recursion, theta joins,
sliding frames), not the way the Spark operators compute them.
"""

from __future__ import annotations

from boxscan import constants as K

W = K.WINDOW
NARROW = 150    # width of the queries with other windows


def ham(kmer: str, box: str) -> str:
    """Mismatches of a k-mer expression with a box."""
    tests = {"R": "('A','G')", "Y": "('C','T')"}
    return "(" + "+".join(
        f"(CASE WHEN substr({kmer},{i + 1},1) IN {tests.get(c, f'({chr(39)}{c}{chr(39)})')} THEN 0 ELSE 1 END)"
        for i, c in enumerate(box)
    ) + ")"


def best_in(window: str, box: str, lo: int, hi: int) -> str:
    """Smallest distance over 0-based offsets lo..hi-1 of a window expression."""
    kmer = f"substr({window}, o + 1, {len(box)})"
    return f"list_min(list_transform(range({lo}, {hi}), lambda o: {ham(kmer, box)}))"


def revcomp(seq: str) -> str:
    return f"reverse(translate(upper({seq}), '{K.COMPLEMENT_FROM}', '{K.COMPLEMENT_TO}'))"


def stranded(seq: str, strand: str = "strand") -> str:
    return f"CASE WHEN {strand} = '-' THEN {revcomp(seq)} ELSE {seq} END"


def logit(hc: str, hd: str) -> str:
    return f"(3 * (7 - {hc}) + 2 * (4 - {hd}) - 21)"


def sigmoid(x: str) -> str:
    return f"(1 / (1 + exp(-CAST({x} AS DOUBLE))))"


PAIRS = "('AT','TA','GC','CG','GT','TG')"


def energy(pair: str) -> str:
    return (f"(CASE WHEN {pair} IN ('GC','CG') THEN -3 WHEN {pair} IN ('AT','TA') THEN -2 "
            f"WHEN {pair} IN ('GT','TG') THEN -1 ELSE 0 END)")


def duplex(left: str, right: str, n: str) -> str:
    pair = f"substr({left}, i, 1) || substr({right}, {n} - i + 1, 1)"
    return f"CAST(coalesce(list_sum(list_transform(range(1, CAST({n} AS INT) + 1), lambda i: {energy(f'({pair})')})), 0) AS DOUBLE)"


def weights(at: int) -> list[str]:
    """Parabola through points -5..5 read at ``at``, as exact fractions."""
    return [
        f"(1.0/11 + {at * x}/110.0 + {(at * at - 10) * (x * x - 10)}/858.0)" for x in range(-5, 6)
    ]


def smoothed(value: str, window: str, pos: str, n: str, digits: int = 9) -> str:
    """Savitzky-Golay value of ``value``; ``pos`` counts from 0."""

    def fit(first: int, at: int) -> str:
        terms = []
        for j, w in enumerate(weights(at)):
            k = first + j
            term = f"lead({value}, {k}) OVER {window}" if k >= 0 else f"lag({value}, {-k}) OVER {window}"
            terms.append(f"{w} * {term}")
        return f"round({' + '.join(terms)}, {digits})"

    cases = [f"WHEN {n} < 11 THEN NULL"]
    for i in range(5):
        cases.append(f"WHEN {pos} = {i} THEN {fit(-i, i - 5)}")
        cases.append(f"WHEN {n} - 1 - {pos} = {i} THEN {fit(i - 10, 5 - i)}")
    return f"CASE {' '.join(cases)} ELSE {fit(-5, 0)} END"


def offsets(w: int = W) -> tuple[tuple[int, int], tuple[int, int]]:
    """First and last offset of a C and of a D box in a window of ``w`` bases."""
    half = (w - 194) // 2
    return (20, 75 + half), (w - 24 - (58 + half), w - 24)


def window_logit(window: str, w: int = W) -> str:
    (c, c_end), (d, d_end) = offsets(w)
    return logit(best_in(window, K.C_BOX, c, c_end + 1), best_in(window, K.D_BOX, d, d_end + 1))


def windows(step: int, threshold: float | None, name: str, W: int = W) -> str:
    """Scored windows of both strands; positives above the threshold, or all."""
    keep = "" if threshold is None else f"WHERE lg > 0 AND prob > {threshold}"
    short = f"""
        SELECT contig, '+' AS strand, 0 AS start, len AS "end", rpad(seq, {W}, 'N') AS w
        FROM contigs WHERE len BETWEEN 1 AND {W}
        UNION ALL
        SELECT contig, '-', 0, len, rpad({revcomp('seq')}, {W}, 'N')
        FROM contigs WHERE len BETWEEN 1 AND {W}"""
    return f"""{name} AS MATERIALIZED (
      SELECT contig, strand, start, "end", prob, CASE WHEN lg > 0 THEN 1 ELSE 0 END AS label FROM (
        SELECT *, round({sigmoid('lg')}, 6) AS prob FROM (
          SELECT contig, '+' AS strand, i AS start, i + {W} AS "end", {logit('c1', 'd1')} AS lg
          FROM frames WHERE i <= len - {W} AND (i % {step} = 0 OR i = len - {W})
          UNION ALL
          SELECT contig, '-', i, i + {W}, {logit('c2', 'd2')}
          FROM frames WHERE i <= len - {W} AND ((len - {W} - i) % {step} = 0 OR i = 0)
          UNION ALL
          SELECT contig, strand, start, "end", {window_logit('w', W)}
          FROM ({short})
        )
      ) {keep}
    )"""


def fold(source: str, name: str) -> str:
    """Greedy merge, one row at a time."""
    joined = ('greatest(least(f."end", o."end") - greatest(f.start, o.start), 0) >= '
              '0.5 * greatest(f."end" - f.start, o."end" - o.start)')
    return f"""{name}_rows AS MATERIALIZED (
      SELECT *, row_number() OVER (PARTITION BY contig, strand ORDER BY start, "end") AS rn FROM {source}
    ), {name}_fold(contig, strand, rn, blk, start, "end", score, n_windows) AS (
      SELECT contig, strand, rn, 1, start, "end", score, n_windows FROM {name}_rows WHERE rn = 1
      UNION ALL
      SELECT o.contig, o.strand, o.rn,
        CASE WHEN {joined} THEN f.blk ELSE f.blk + 1 END,
        CASE WHEN {joined} THEN f.start ELSE o.start END,
        o."end",
        CASE WHEN {joined} THEN (f.score + o.score) / 2 ELSE o.score END,
        CASE WHEN {joined} THEN f.n_windows + o.n_windows ELSE o.n_windows END
      FROM {name}_fold f JOIN {name}_rows o
        ON o.contig = f.contig AND o.strand = f.strand AND o.rn = f.rn + 1
    ), {name} AS MATERIALIZED (
      SELECT contig, strand, start, arg_max("end", rn) AS "end", arg_max(score, rn) AS score,
             max(n_windows) AS n_windows
      FROM {name}_fold GROUP BY contig, strand, blk, start
    )"""


def islands(source: str, name: str) -> str:
    return f"""{name} AS MATERIALIZED (
      SELECT * EXCLUDE (grp), min(start) OVER (PARTITION BY contig, strand, grp) AS head FROM (
        SELECT *, sum(fresh) OVER (PARTITION BY contig, strand ORDER BY start, "end") AS grp FROM (
          SELECT *, CASE WHEN start - lag(start) OVER (PARTITION BY contig, strand ORDER BY start, "end") <= 1
                         THEN 0 ELSE 1 END AS fresh FROM {source}))
    )""".replace("EXCLUDE (grp)", "EXCLUDE (grp, fresh)")


def blocks(source: str, name: str) -> str:
    return f"""{name} AS MATERIALIZED (
      SELECT contig, strand, min(start) AS start, max("end") AS "end", round(avg(prob), 9) AS score,
             count(*) AS n_windows
      FROM {source} GROUP BY contig, strand, head
    )"""


def block_id(alias: str = "") -> str:
    return f"{alias}contig || ':' || {alias}start || '-' || {alias}\"end\" || ':' || {alias}strand"


CONTIGS = """contigs AS MATERIALIZED (
      SELECT contig, seq, length(seq) AS len FROM (
        SELECT CAST(doc_id AS VARCHAR) AS contig, doc_id,
               translate(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')),
                         'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAN') AS seq
        FROM documents)
    )"""

PEAKS = """peaks AS MATERIALIZED (
      SELECT CASE WHEN doc_id % 97 = 5 THEN 'x' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS contig,
             st AS start,
             CASE WHEN (doc_id + k) % 89 = 7 THEN st ELSE least(st + wd, greatest(len, st + 1)) END AS "end",
             'p' || doc_id || '_' || (k - CASE WHEN (doc_id + k) % 13 = 12 THEN least(k, 1) ELSE 0 END) AS gene_id,
             '.' AS score,
             ['+', '-', '.'][1 + (doc_id + k) % 3] AS strand,
             doc_id * 1000000 + k AS row_no
      FROM (
        SELECT doc_id, len, k, k * 300 + (doc_id * 37 + k * 11) % 260 AS st,
               50 + (doc_id * 31 + k * 17) % 351 AS wd
        FROM (SELECT doc_id, len, unnest(range(0, len // 300 + 1)) AS k FROM (
          SELECT doc_id, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS len FROM documents)))
    )"""

def pos(W: int = W) -> str:
    return f"""pos AS MATERIALIZED (
      SELECT contig, len, i, {ham('k7', K.C_BOX)} AS hc, {ham('k7', K.D_BOX)} AS hd,
             {ham('k7', 'TCATCAY')} AS rc, {ham('k7', 'TCAG')} AS rd
      FROM (SELECT contig, len, i, substr(seq, i + 1, 7) AS k7
            FROM (SELECT contig, seq, len, unnest(range(0, len)) AS i FROM contigs WHERE len > {W}))
    )"""

def frames(w: int = W) -> str:
    (c, c_end), (d, d_end) = offsets(w)

    def least(column: str, first: int, last: int, name: str) -> str:
        return (f"min({column}) OVER (PARTITION BY contig ORDER BY i ROWS BETWEEN {first} FOLLOWING "
                f"AND {last} FOLLOWING) AS {name}")

    # a box at offset o of a minus window ends o bases before the end of the plus window
    spans = ", ".join([
        least("hc", c, c_end, "c1"), least("hd", d, d_end, "d1"),
        least("rc", w - 7 - c_end, w - 7 - c, "c2"), least("rd", w - 4 - d_end, w - 4 - d, "d2"),
    ])
    return f"""frames AS MATERIALIZED (
      SELECT contig, len, i, {spans}
      FROM pos
    )"""


POS, FRAMES = pos(), frames()
SCAN_CTES = [CONTIGS, POS, FRAMES]


def positive(threshold: float, step: int = K.STEP, width: int = W) -> list[str]:
    return [CONTIGS, pos(width), frames(width), windows(step, threshold, "hits", width)]


def merged(threshold: float, width: int = W) -> list[str]:
    return [*positive(threshold, width=width), islands("hits", "isl"), blocks("isl", "blk"), fold("blk", "merged")]


def centred(threshold: float, W: int = W) -> list[str]:
    return [*merged(threshold, W), f"""centre AS MATERIALIZED (
      SELECT contig, start + CAST(floor(("end" - start - {W}) / 2) AS BIGINT) AS start,
             "end" - CAST(ceil(("end" - start - {W}) / 2) AS BIGINT) AS "end", strand, score,
             {block_id()} AS block_id, start AS block_start, "end" AS block_end
      FROM merged WHERE "end" - start >= {W + K.CONSECUTIVE_WINDOWS - 1}
    ), centre_seen AS MATERIALIZED (
      SELECT c.*, EXISTS (SELECT 1 FROM hits h WHERE h.contig = c.contig AND h.strand = c.strand
                          AND h.start = c.start AND h."end" = c."end") AS present
      FROM centre c
    )"""]


def confirmed(threshold: float, width: int = W) -> list[str]:
    seq = "substr(t.seq, c.start + 1, c.\"end\" - c.start)"
    return [*centred(threshold, width), f"""kept AS MATERIALIZED (
      SELECT contig, start, "end", strand, score, block_id, block_start, block_end, window_seq FROM (
        SELECT *, {window_logit('window_seq', width)} AS lg
        FROM (SELECT c.*, {stranded(seq, 'c.strand')} AS window_seq
              FROM centre_seen c JOIN contigs t ON t.contig = c.contig))
      WHERE present OR (lg > 0 AND round({sigmoid('lg')}, 6) > {threshold})
    )"""]


SHORT = f"""short_kept AS MATERIALIZED (
      SELECT h.contig, h.start, h."end", h.strand, h.prob AS score, {block_id('h.')} AS block_id,
             h.start AS block_start, h."end" AS block_end, {stranded('t.seq', 'h.strand')} AS window_seq
      FROM hits h JOIN contigs t ON t.contig = h.contig WHERE t.len <= {W}
    )"""


def found(threshold: float) -> list[str]:
    return [*confirmed(threshold), SHORT, """cand AS MATERIALIZED (
      SELECT *, 'CD_' || row_number() OVER (ORDER BY contig, start, strand, "end", block_id) AS gene_id
      FROM (SELECT * FROM kept UNION ALL SELECT * FROM short_kept)
    )"""]


# Peaks prepared for scoring: centred, deduplicated, on known strands, widened.
CENTRED_PEAKS = f"""valid AS MATERIALIZED (
      SELECT * FROM peaks WHERE start < "end" AND start >= 0
    ), centred_peaks AS MATERIALIZED (
      SELECT contig,
        CASE WHEN "end" - start > {W} THEN start + CAST(floor(("end" - start - {W}) / 2) AS BIGINT) ELSE start END AS start,
        CASE WHEN "end" - start > {W} THEN "end" - CAST(ceil(("end" - start - {W}) / 2) AS BIGINT) ELSE "end" END AS "end",
        gene_id || CASE WHEN "end" - start > {W} THEN '_center_window' ELSE '' END AS gene_id,
        score, strand, row_no
      FROM valid
    )"""


def dedup(source: str, name: str) -> str:
    return f"""{name} AS MATERIALIZED (
      SELECT * EXCLUDE (a, b) FROM (
        SELECT *, row_number() OVER (PARTITION BY contig, start, "end", strand ORDER BY row_no) AS b FROM (
          SELECT *, row_number() OVER (PARTITION BY gene_id ORDER BY row_no) AS a FROM {source})
        WHERE a = 1) WHERE b = 1
    )"""


PREPARED = [CONTIGS, PEAKS, CENTRED_PEAKS, dedup("centred_peaks", "unique_peaks"), f"""sided AS MATERIALIZED (
      SELECT contig, start, "end", gene_id, strand FROM unique_peaks WHERE strand IN ('+', '-')
      UNION ALL
      SELECT contig, start, "end", gene_id || '_' || s, s
      FROM (SELECT *, unnest(['+', '-']) AS s FROM unique_peaks WHERE strand NOT IN ('+', '-'))
    ), prepared AS MATERIALIZED (
      SELECT * FROM (
        SELECT p.contig,
          greatest(p.start - greatest(CAST(floor(({W} - (p."end" - p.start)) / 2) AS BIGINT), 0), 0) AS start,
          least(p."end" + greatest(CAST(ceil(({W} - (p."end" - p.start)) / 2) AS BIGINT), 0), t.len) AS "end",
          p.gene_id, p.strand
        FROM sided p JOIN contigs t ON t.contig = p.contig)
      WHERE start < "end"
    ), prepared_seq AS MATERIALIZED (
      SELECT p.*, {stranded('substr(t.seq, p.start + 1, p."end" - p.start)', 'p.strand')} AS window_seq
      FROM prepared p JOIN contigs t ON t.contig = p.contig
    ), scored_peaks AS MATERIALIZED (
      SELECT *, round(greatest(p_pos, 1 - p_pos), 6) AS p_top FROM (
        SELECT * EXCLUDE (lg), round({sigmoid('lg')}, 6) AS p_pos, CASE WHEN lg > 0 THEN 1 ELSE 0 END AS label FROM (
          SELECT *, {logit(best_in("rpad(window_seq, 194, 'N')", K.C_BOX, 20, 76), best_in("rpad(window_seq, 194, 'N')", K.D_BOX, 112, 171))} AS lg
          FROM prepared_seq))
    )"""]


def peak_candidates(threshold: float) -> list[str]:
    return [*PREPARED, f"""cand AS MATERIALIZED (
      SELECT contig, start, "end", strand, p_top AS score, gene_id AS block_id, window_seq, gene_id
      FROM scored_peaks WHERE label = 1 AND p_top > {threshold}
    )"""]


_PAD = "rpad(window_seq, 194, 'N')"
_MASKED = "rpad(substr(window_seq, 1, m) || 'NNNNNN' || substr(window_seq, m + 7), 194, 'N')"

# Attribution: masked k-mers, their mean per nucleotide, label and probability.
ATTRIBUTED = [f"""full_score AS MATERIALIZED (
      SELECT gene_id, window_seq, length(window_seq) AS n, lg, {sigmoid('lg')} AS p FROM (
        SELECT gene_id, window_seq, {logit(best_in(_PAD, K.C_BOX, 20, 76), best_in(_PAD, K.D_BOX, 112, 171))} AS lg FROM cand)
    ), drops AS MATERIALIZED (
      SELECT gene_id, n, m, p - {sigmoid('lgm')} AS v FROM (
        SELECT gene_id, n, m, p, {window_logit('w', W)} AS lgm FROM (
          SELECT gene_id, n, p, m, {_MASKED} AS w
          FROM (SELECT *, unnest(range(0, greatest(n - 5, 0))) AS m FROM full_score)))
    ), signal AS MATERIALIZED (
      SELECT d.gene_id, nt AS pos, any_value(d.n) AS n, avg(v) AS v
      FROM drops d, unnest(range(0, 194)) AS r(nt)
      WHERE nt < d.n AND d.m BETWEEN nt - 5 AND nt
      GROUP BY d.gene_id, nt
    ), attributed AS MATERIALIZED (
      SELECT c.*, CASE WHEN f.lg > 0 THEN 'CD_snoRNA' ELSE 'Other' END AS predicted_label,
             round(greatest(round(f.p, 6), 1 - round(f.p, 6)), 6) AS probability
      FROM cand c JOIN full_score f ON f.gene_id = c.gene_id
    )"""]

SIGNAL_PEAKS = [*ATTRIBUTED, f"""framed AS MATERIALIZED (
      SELECT gene_id, pos + 1 AS pos, n + 2 AS n, v FROM signal
      UNION ALL SELECT gene_id, 0, n + 2, 0.0 FROM full_score WHERE n >= 6
      UNION ALL SELECT gene_id, n + 1, n + 2, 0.0 FROM full_score WHERE n >= 6
    ), smooth AS MATERIALIZED (
      SELECT gene_id, pos, n, {smoothed('v', 'w', 'pos', 'n')} AS s FROM framed
      WINDOW w AS (PARTITION BY gene_id ORDER BY pos)
    ), signal_peaks AS MATERIALIZED (
      SELECT gene_id, pos, s AS height FROM (
        SELECT *, least(s - lag(s) OVER w, s - lead(s) OVER w) AS fall FROM smooth
        WINDOW w AS (PARTITION BY gene_id ORDER BY pos))
      WHERE pos > 0 AND pos < n - 1 AND s >= {K.PEAK_HEIGHT} AND round(fall, 9) >= {K.PEAK_DROP}
    )"""]

BOX_HITS = f"""box_hits AS MATERIALIZED (
      SELECT gene_id, i + 1 AS start, n,
             CASE WHEN i + 7 <= n THEN {ham('substr(window_seq, i + 1, 7)', K.C_BOX)} END AS cd,
             CASE WHEN i + 4 <= n THEN {ham('substr(window_seq, i + 1, 4)', K.D_BOX)} END AS dd
      FROM (SELECT gene_id, window_seq, length(window_seq) AS n,
                   unnest(range(0, length(window_seq))) AS i FROM cand)
    )"""

# C/D pairs at peaks, exact-D rescue, limits, primes, scores, genes.
BOXED = [*SIGNAL_PEAKS, BOX_HITS, f"""offers AS MATERIALIZED (
      SELECT p.gene_id, p.pos, p.height,
        CASE WHEN p.pos BETWEEN 28 AND 75 OR p.pos BETWEEN 117 AND 170 THEN 0 ELSE 1 END AS lenient,
        CASE WHEN p.pos <= 82 THEN p.pos - 7 ELSE 193 - p.pos - 7 END AS c_lo,
        CASE WHEN p.pos <= 82 THEN p.pos + 7 ELSE 193 - p.pos + 8 END AS c_hi,
        CASE WHEN p.pos <= 82 THEN 193 - p.pos - 7 ELSE p.pos - 4 END AS d_lo,
        CASE WHEN p.pos <= 82 THEN 193 - p.pos + 8 ELSE p.pos + 4 END AS d_hi
      FROM signal_peaks p JOIN attributed a ON a.gene_id = p.gene_id AND a.predicted_label <> 'Other'
      WHERE p.pos BETWEEN 21 AND 82 OR p.pos BETWEEN 113 AND 174
    ), offer_c AS MATERIALIZED (
      SELECT * FROM (
        SELECT o.gene_id, o.pos, h.start, h.cd AS dist,
               row_number() OVER (PARTITION BY o.gene_id, o.pos ORDER BY h.cd, h.start) AS r
        FROM offers o JOIN box_hits h ON h.gene_id = o.gene_id AND h.start > o.c_lo AND h.start + 6 <= o.c_hi
        WHERE h.cd <= 3) WHERE r = 1
    ), offer_d AS MATERIALIZED (
      SELECT * FROM (
        SELECT o.gene_id, o.pos, h.start, h.dd AS dist,
               row_number() OVER (PARTITION BY o.gene_id, o.pos ORDER BY h.dd, h.start DESC) AS r
        FROM offers o JOIN box_hits h ON h.gene_id = o.gene_id AND h.start > o.d_lo AND h.start + 3 <= o.d_hi
        WHERE h.dd <= 2) WHERE r = 1
    ), paired AS MATERIALIZED (
      SELECT o.*, c.start AS cs, c.dist AS cdist, d.start AS ds, d.dist AS ddist,
             coalesce(c.dist, 7) + coalesce(d.dist, 4) AS total
      FROM offers o LEFT JOIN offer_c c ON c.gene_id = o.gene_id AND c.pos = o.pos
      LEFT JOIN offer_d d ON d.gene_id = o.gene_id AND d.pos = o.pos
      WHERE coalesce(c.dist, 7) + coalesce(d.dist, 4) < 11
    ), first_pass AS MATERIALIZED (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gene_id ORDER BY total, height DESC, pos) AS r
                     FROM paired WHERE lenient = 0) WHERE r = 1
    ), second_pass AS MATERIALIZED (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gene_id ORDER BY total, lenient, height DESC, pos) AS r
                     FROM paired) WHERE r = 1
    ), best_pair AS MATERIALIZED (
      SELECT a.*, 
        CASE WHEN f.cs IS NOT NULL AND f.ds IS NOT NULL THEN f.cs ELSE s.cs END AS cs,
        CASE WHEN f.cs IS NOT NULL AND f.ds IS NOT NULL THEN f.cdist ELSE s.cdist END AS cdist,
        CASE WHEN f.cs IS NOT NULL AND f.ds IS NOT NULL THEN f.ds ELSE s.ds END AS ds0,
        CASE WHEN f.cs IS NOT NULL AND f.ds IS NOT NULL THEN f.ddist ELSE s.ddist END AS ddist0
      FROM attributed a LEFT JOIN first_pass f ON f.gene_id = a.gene_id
      LEFT JOIN second_pass s ON s.gene_id = a.gene_id
      WHERE a.predicted_label <> 'Other'
    ), rescue AS MATERIALIZED (
      SELECT b.gene_id, max(h.start) AS start
      FROM best_pair b JOIN box_hits h ON h.gene_id = b.gene_id AND h.dd = 0
        AND h.start > b.ds0 AND h.start + 3 <= least({W - K.FLANK}, b.ds0 + 3 + 25)
      WHERE b.ddist0 > 0 GROUP BY b.gene_id
    ), cd AS MATERIALIZED (
      SELECT *, coalesce(cs, {W} - d_found - 1, {K.FLANK}) AS c_limit,
                coalesce(d_found, {W} - cs - 1, {W - K.FLANK}) AS d_limit
      FROM (SELECT b.*, coalesce(r.start, b.ds0) AS ds,
                   CASE WHEN r.start IS NOT NULL THEN 0 ELSE b.ddist0 END AS ddist,
                   coalesce(r.start, b.ds0) + 3 AS d_found, length(b.window_seq) AS n
            FROM best_pair b LEFT JOIN rescue r ON r.gene_id = b.gene_id)
    )"""]


def primes(source: str) -> str:
    """C'/D' pairs by listing all of them; ``source`` has c_limit, d_limit and n."""
    return f"""c_primes AS MATERIALIZED (
      SELECT h.gene_id, h.start, h.cd AS dist FROM {source} b JOIN box_hits h ON h.gene_id = b.gene_id
      WHERE h.cd <= 3 AND h.start > b.n // 2 AND h.start + 6 <= b.d_limit - 14
    ), d_primes AS MATERIALIZED (
      SELECT h.gene_id, h.start, h.dd AS dist FROM {source} b JOIN box_hits h ON h.gene_id = b.gene_id
      WHERE h.dd <= 2 AND h.start > b.c_limit + 17 AND h.start + 3 <= b.n // 2
    ), prime_pairs AS MATERIALIZED (
      SELECT * FROM (
        SELECT d.gene_id, c.start AS cps, c.dist AS cpd, d.start AS dps, d.dist AS dpd,
               row_number() OVER (PARTITION BY d.gene_id ORDER BY c.dist + d.dist, d.dist, d.start, c.start) AS r
        FROM d_primes d JOIN c_primes c ON c.gene_id = d.gene_id AND d.start + 3 + 2 <= c.start) WHERE r = 1
    ), c_alone AS MATERIALIZED (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gene_id ORDER BY dist, start) AS r FROM c_primes) WHERE r = 1
    ), d_alone AS MATERIALIZED (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gene_id ORDER BY dist, start) AS r FROM d_primes) WHERE r = 1
    ), primed AS MATERIALIZED (
      SELECT b.*,
        CASE WHEN p.gene_id IS NOT NULL THEN p.cps WHEN d.gene_id IS NULL THEN c.start END AS cps,
        CASE WHEN p.gene_id IS NOT NULL THEN p.cpd WHEN d.gene_id IS NULL THEN c.dist END AS cpd,
        CASE WHEN p.gene_id IS NOT NULL THEN p.dps ELSE d.start END AS dps,
        CASE WHEN p.gene_id IS NOT NULL THEN p.dpd ELSE d.dist END AS dpd
      FROM {source} b LEFT JOIN prime_pairs p ON p.gene_id = b.gene_id
      LEFT JOIN c_alone c ON c.gene_id = b.gene_id LEFT JOIN d_alone d ON d.gene_id = b.gene_id
    )"""


GENES_CTES = [*BOXED, primes("cd"), f"""limited AS MATERIALIZED (
      SELECT *, coalesce(cdist, 7) AS score_c, coalesce(ddist, 4) AS score_d,
        coalesce(cdist, 7) + coalesce(ddist, 4) + coalesce(cpd, 7) + coalesce(dpd, 4) AS box_score,
        CASE WHEN strand = '-' THEN "end" - hi ELSE start + lo END AS gene_start,
        CASE WHEN strand = '-' THEN "end" - lo ELSE start + hi END AS gene_end,
        substr(window_seq, lo + 1, hi - lo) AS predicted_sequence,
        substr(window_seq, greatest(lo - 15, 0) + 1, least(hi + 15, n) - greatest(lo - 15, 0)) AS predicted_extended_sequence
      FROM (SELECT *, CAST(greatest(c_limit - 6, 0) AS BIGINT) AS lo, CAST(least(d_limit + 5, n) AS BIGINT) AS hi FROM primed)
    ), genes AS MATERIALIZED (
      SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY contig, start, "end", strand ORDER BY box_score, gene_id) AS r FROM (
          SELECT gene_id, contig, gene_start AS start, gene_end AS "end", strand, probability AS probability_CD, box_score,
            coalesce(substr(window_seq, cs, 7), 'NNNNNNN') AS C_MOTIF, coalesce(cs - lo, 0) AS C_START, coalesce(cs - lo + 6, 0) AS C_END, score_c,
            coalesce(substr(window_seq, ds, 4), 'NNNN') AS D_MOTIF, coalesce(ds - lo, 0) AS D_START, coalesce(ds - lo + 3, 0) AS D_END, score_d,
            coalesce(substr(window_seq, cps, 7), 'NNNNNNN') AS C_PRIME_MOTIF, coalesce(cps - lo, 0) AS C_PRIME_START, coalesce(cps - lo + 6, 0) AS C_PRIME_END,
            coalesce(substr(window_seq, dps, 4), 'NNNN') AS D_PRIME_MOTIF, coalesce(dps - lo, 0) AS D_PRIME_START, coalesce(dps - lo + 3, 0) AS D_PRIME_END,
            predicted_sequence, predicted_extended_sequence, window_seq
          FROM limited)) WHERE r = 1
    )"""]

REFINED = f"""refined AS MATERIALIZED (
      SELECT contig, start, "end", gene_id, block_id,
             round(greatest(round({sigmoid('lg2')}, 6), 1 - round({sigmoid('lg2')}, 6)), 6) AS probability_expressed_pseudogene,
             CASE WHEN lg2 > 0 THEN 1 ELSE 0 END AS second_model_prediction
      FROM (SELECT *, 4 - 2 * ({best_in('w', K.C_BOX, 20, 76)} + {best_in('w', K.D_BOX, 112, 171)})
              + list_sum(list_transform(range(1, 21), lambda i: CASE WHEN substr(w, i, 1) || substr(w, 195 - i, 1) IN {PAIRS} THEN 1 ELSE 0 END)) - 8 AS lg2
            FROM (SELECT *, {_PAD} AS w FROM cand))
    )"""


def pairing(left: str, right: str, n: str) -> str:
    pair = f"(substr({left}, length({left}) - j + 1, 1) || substr({right}, j, 1))"
    return f"coalesce(array_to_string(list_transform(range(1, CAST({n} AS INT) + 1), lambda j: CASE WHEN {energy(pair)} < 0 THEN '(' ELSE '.' END), ''), '')"


def stem_score(mark: str) -> str:
    """Brackets less the dots that lie between the first and the last of them."""
    inner = f"length(trim({mark}, '.')) - length(replace(trim({mark}, '.'), '.', ''))"
    return f"greatest(length(replace({mark}, '.', '')) - ({inner}), 0)"


FEATURES = f"""featured AS MATERIALIZED (
      SELECT *, round(ge / length(predicted_sequence), 2) AS normalized_sno_stability,
             se * stem AS terminal_combined, round(se * stem, 2) + 0.0 AS terminal_stem_score
      FROM (SELECT *, {stem_score('mark')} AS stem FROM (
        SELECT *, {pairing('lf', 'rf', 'least(length(lf), length(rf))')} AS mark,
               {duplex('lf', 'rf', 'length(rf)')} AS se,
               {duplex('substr(predicted_sequence, 1, length(predicted_sequence) // 2)',
                       'substr(predicted_sequence, length(predicted_sequence) - length(predicted_sequence) // 2 + 1)',
                       'length(predicted_sequence) // 2')} AS ge
        FROM (SELECT *, substr(predicted_extended_sequence, 1, 20) AS lf,
                     substr(predicted_extended_sequence, greatest(length(predicted_extended_sequence) - 19, 1), 20) AS rf
              FROM genes)))
    )"""

RULES = f"""ruled AS MATERIALIZED (
      SELECT *, CASE
          WHEN C_MOTIF = 'NNNNNNN' OR D_MOTIF = 'NNNN' THEN 'CD_snoRNA_pseudogene'
          WHEN probability_expressed_pseudogene > {K.PROB_SECOND}
            THEN CASE WHEN second_model_prediction = 0 AND fav < 4 THEN 'CD_snoRNA_pseudogene' ELSE 'expressed_CD_snoRNA' END
          WHEN score_c >= 2 AND score_d >= 1 THEN 'CD_snoRNA_pseudogene'
          WHEN terminal_combined <= -25 THEN 'expressed_CD_snoRNA'
          WHEN fav <= 2 THEN 'CD_snoRNA_pseudogene'
          WHEN second_model_prediction = 1 THEN 'expressed_CD_snoRNA'
          ELSE 'CD_snoRNA_pseudogene' END AS predicted_label
      FROM (SELECT f.*, r.probability_expressed_pseudogene, r.second_model_prediction,
              CAST(terminal_combined <= -25 AS INT) + CAST(normalized_sno_stability <= -0.2 AS INT)
              + CAST(box_score <= 5 AS INT) + CAST(score_c <= 2 AS INT) + CAST(score_d < 1 AS INT) AS fav
            FROM featured f JOIN refined r ON r.gene_id = f.gene_id)
    )"""

GENE_INTS = [f"{box}_{side}" for box in ("C", "D", "C_PRIME", "D_PRIME") for side in ("START", "END")]
BOXES = ("C_MOTIF, C_START, C_END, D_MOTIF, D_START, D_END, C_PRIME_MOTIF, C_PRIME_START, C_PRIME_END, "
         "D_PRIME_MOTIF, D_PRIME_START, D_PRIME_END")
FINAL_COLUMNS = (f'gene_id, contig AS chr, start, "end", strand, probability_CD, box_score, {BOXES}, '
                 "terminal_stem_score, normalized_sno_stability, probability_expressed_pseudogene, "
                 "predicted_label, predicted_sequence")
FINAL = f"""final AS MATERIALIZED (
      SELECT {FINAL_COLUMNS} FROM ruled WHERE NOT contains(predicted_sequence, 'N')
    )"""

CANDIDATES = found(0.99)
LABELLED = [*CANDIDATES, *GENES_CTES, REFINED, FEATURES, RULES, FINAL]


def query(ctes: list[str], select: str, ints: list[str] | None = None) -> str:
    """One statement; ``ints`` are columns that the Spark side keeps as 32-bit integers."""
    if ints:
        casts = ", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in ints)
        select = f"SELECT * REPLACE ({casts}) FROM ({select})"
    return "WITH RECURSIVE " + ",\n    ".join(ctes) + "\n" + select if ctes else select


_TILES = """tiles AS MATERIALIZED (
      SELECT contig, len, t AS tile, t * 500 AS tile_start, least((t + 1) * 500, len) AS tile_end,
             substr(seq, t * 500 + 1, 693) AS seq
      FROM (SELECT *, unnest(range(0, (len - 1) // 500 + 1)) AS t FROM contigs WHERE len > 0)
    )"""

_CHECK = "SELECT '{0}' AS \"check\", '{1}' AS severity, count(*) AS n, min(CAST({2} AS VARCHAR)) AS sample FROM {3}"


def _text(names: list[str], sep: str = "=", quote: str = "") -> list[str]:
    return [f"'{n}{sep}{quote}' || CAST({n} AS VARCHAR) || '{quote}'" for n in names]


_BOX_NAMES = BOXES.split(", ")
_STRUCTURE = ["terminal_stem_score", "normalized_sno_stability", "probability_expressed_pseudogene"]
_GENE_ATTR = ["'gene_id \"' || gene_id || '\"'", "'gene_version \"1\"'", "'gene_name \"' || gene_id || '\"'",
              "'gene_source \"boxscan\"'", "'gene_biotype \"' || biotype || '\"'"]
_TRANSCRIPT_ATTR = ["'transcript_id \"' || gene_id || '.t1\"'", "'transcript_version \"1\"'",
                    "'transcript_name \"' || gene_id || '-1\"'", "'transcript_source \"boxscan\"'",
                    "'transcript_biotype \"' || biotype || '\"'", "'tag \"basic\"'", "'transcript_support_level \"NA\"'"]
_EXON_ATTR = ["'exon_id \"' || gene_id || '.e1\"'", "'exon_number \"1\"'", "'exon_version \"1\"'"]


def _gtf(feature: str, cells: list[str]) -> str:
    text = " || '; ' || ".join(cells)
    return (f"SELECT chr, 'boxscan' AS source, '{feature}' AS feature, start + 1 AS start, \"end\", '.' AS score, "
            f"strand, '.' AS frame, {text} || ';' AS attributes, gene_id FROM labelled")


def _box(letter: str) -> str:
    return f"{letter}_MOTIF || '/' || {letter}_START || '/' || {letter}_END"


_FASTA_HEAD = (
    "'>' || gene_id || ' ' || chr || ':' || start || '-' || \"end\" || ' (' || strand || ') probability_CD=' || probability_CD"
    f" || ' C=' || {_box('C')} || ' D_PRIME=' || {_box('D_PRIME')} || ' C_PRIME=' || {_box('C_PRIME')}"
    f" || ' D=' || {_box('D')} || ' box_score=' || box_score"
)

_BED = (
    "SELECT chr, start, \"end\", gene_id, '.' AS empty_score, strand, "
    + " || '; ' || ".join(_text(["probability_CD", "box_score", *_BOX_NAMES, *_STRUCTURE, "predicted_label", "predicted_sequence"]))
    + " AS attributes FROM final"
)
_BIOTYPES = """labelled AS MATERIALIZED (
      SELECT *, CASE WHEN predicted_label = 'expressed_CD_snoRNA' THEN 'CD_snoRNA' ELSE predicted_label END AS biotype FROM final)"""
_GTF = " UNION ALL ".join([
    _gtf("gene", [*_GENE_ATTR, *_text(["probability_CD", "box_score", *_BOX_NAMES, *_STRUCTURE], " ", '"')]),
    _gtf("transcript", [*_GENE_ATTR, *_TRANSCRIPT_ATTR]),
    _gtf("exon", [*_GENE_ATTR, *_TRANSCRIPT_ATTR, *_EXON_ATTR]),
])
_RECORDS = (
    f"SELECT chr, start, strand, \"end\", gene_id, {_FASTA_HEAD} || ' terminal_stem_score=' || terminal_stem_score "
    "|| ' normalized_sno_stability=' || normalized_sno_stability || ' predicted_label=' || predicted_label "
    "|| chr(10) || predicted_sequence AS record FROM final"
)

_EVENTS = """ev AS MATERIALIZED (
      SELECT user_id AS id, event_id AS seq_no, value,
             row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
             count(*) OVER (PARTITION BY user_id) AS n
      FROM events
    )"""
_EV_SMOOTH = f"""evs AS MATERIALIZED (
      SELECT id, seq_no, pos, n, {smoothed('value', 'w', 'pos', 'n')} AS s FROM ev
      WINDOW w AS (PARTITION BY id ORDER BY pos)
    )"""

_FLANKED = f"""flanked AS MATERIALIZED (
      SELECT gene_id, substr(window_seq, greatest(c_limit - 20, 1), c_limit - greatest(c_limit - 20, 1)) AS left_flank,
             substr(window_seq, d_limit + 1, 20) AS right_flank FROM cd
    )"""

_PEAK_BOXES = BOX_HITS.replace("FROM cand)", "FROM fixed)")
_FIXED = """fixed AS MATERIALIZED (
      SELECT gene_id, strand, window_seq, length(window_seq) AS n, 25 AS c_limit, 170 AS d_limit FROM prepared_seq
    )"""

ORACLE: dict[str, str] = {
    "contig_sizes": query([CONTIGS], "SELECT contig, len AS length FROM contigs WHERE len > 0"),
    "duplicate_names": query([CONTIGS],
        "SELECT md5(seq) AS contig, count(*) AS n FROM contigs GROUP BY md5(seq) HAVING count(*) > 1"),
    "fasta_scan": query([CONTIGS, _TILES], "SELECT contig, tile, len AS length, md5(seq) AS digest FROM tiles"),
    "fasta_ranges": query([CONTIGS, _TILES], "SELECT contig, tile, len AS length, md5(seq) AS digest FROM tiles"),
    "fasta_checks": query(["""named AS MATERIALIZED (
      SELECT doc_id, CAST(CASE WHEN doc_id % 89 = 4 THEN doc_id - 1 ELSE doc_id END AS VARCHAR) AS contig,
             length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n FROM documents
    ), headers AS MATERIALIZED (
      SELECT contig, CASE WHEN doc_id % 97 = 3 THEN '> ' ELSE '>' END || contig AS header FROM named
    ), filled AS MATERIALIZED (
      SELECT contig, sum(n) AS length FROM named WHERE doc_id % 83 <> 6 GROUP BY contig)"""],
        " UNION ALL ".join([
            _CHECK.format("empty_entry", "error", "contig",
                          "headers WHERE contig NOT IN (SELECT contig FROM filled WHERE length > 0)"),
            _CHECK.format("spaced_header", "error", "header", "headers WHERE header LIKE '> %' OR header = '>'"),
            _CHECK.format("duplicate_name", "error", "contig",
                          "(SELECT contig FROM headers GROUP BY contig HAVING count(*) > 1)"),
            "SELECT 'no_entries', 'error', CASE WHEN count(*) = 0 THEN 1 ELSE 0 END, NULL FROM headers",
            "SELECT 'many_entries', 'warning', CASE WHEN count(*) > 25 THEN count(*) ELSE 0 END, NULL FROM headers",
        ])),
    "bed_scan": query([PEAKS], 'SELECT contig, start, "end", gene_id, score, strand FROM peaks'),
    "bed_checks": query([CONTIGS, PEAKS], " UNION ALL ".join([
        "SELECT 'not_tabbed' AS \"check\", 'error' AS severity, 0 AS n, NULL AS sample",
        "SELECT 'empty_bed', 'error', CASE WHEN count(*) = 0 THEN 1 ELSE 0 END, '7-7' FROM peaks",
        "SELECT 'uneven_columns', 'error', 0, '7-7'",
        "SELECT 'too_few_columns', 'error', 0, '7-7'",
        _CHECK.format("unknown_contig", "error", "contig",
                      "(SELECT DISTINCT contig FROM peaks WHERE contig NOT IN (SELECT contig FROM contigs))"),
        _CHECK.format("start_not_before_end", "error", "gene_id", 'peaks WHERE start >= "end"'),
        _CHECK.format("longer_than_window", "warning", "gene_id", f'peaks WHERE "end" - start > {W}'),
        _CHECK.format("duplicated_id", "warning", "gene_id",
                      "(SELECT gene_id FROM peaks GROUP BY gene_id HAVING count(*) > 1)"),
        "SELECT 'scoring_units', 'info', count(*) + count(*) FILTER (strand NOT IN ('+', '-')), NULL FROM peaks",
    ])),
    "bed_line_checks": query([PEAKS, """lines AS MATERIALIZED (
      SELECT *, CASE WHEN row_no % 83 = 1 THEN 1 WHEN row_no % 71 = 2 THEN 4 ELSE 6 END AS cells,
        row_number() OVER (PARTITION BY contig ORDER BY row_no) AS nth,
        CASE WHEN row_no % 67 = 3 THEN '1e3' ELSE CAST(start AS VARCHAR) END AS place
      FROM peaks
    ), written AS MATERIALIZED (
      SELECT *, CASE cells WHEN 1 THEN contig || ' ' || place || ' ' || "end" || ' ' || gene_id
        WHEN 4 THEN contig || chr(9) || place || chr(9) || "end" || chr(9) || gene_id
        ELSE contig || chr(9) || place || chr(9) || "end" || chr(9) || gene_id || chr(9) || score || chr(9) || strand
        END AS line
      FROM lines
    ), span AS MATERIALIZED (
      SELECT count(DISTINCT cells) AS kinds, min(cells) || '-' || max(cells) AS sample, max(cells) AS most FROM lines
    )"""], """SELECT 'not_tabbed' AS "check", 'error' AS severity, count(*) AS n, min(CAST(cells AS VARCHAR)) AS sample
      FROM lines WHERE cells < 2
      UNION ALL SELECT 'empty_bed', 'error', CASE WHEN kinds = 0 THEN 1 ELSE 0 END, sample FROM span
      UNION ALL SELECT 'uneven_columns', 'error', CASE WHEN kinds > 1 THEN kinds ELSE 0 END, sample FROM span
      UNION ALL SELECT 'too_few_columns', 'error', CASE WHEN kinds = 1 AND most < 6 THEN 1 ELSE 0 END, sample FROM span
      UNION ALL SELECT 'no_number', 'error', count(*), min(line) FROM written
      WHERE (cells = 1 OR place = '1e3') AND nth > 1"""),
    "missing_contigs": query([CONTIGS, PEAKS],
        "SELECT contig, count(*) AS n_peaks FROM peaks WHERE contig NOT IN (SELECT contig FROM contigs) GROUP BY contig"),
    "reverse_complement": query([CONTIGS], f"SELECT contig, {revcomp('seq')} AS rc FROM contigs"),
    "kmer_tokens": query([CONTIGS, """parts AS MATERIALIZED (
      SELECT contig, t AS tile, substr(seq, t * 256 + 1, 261) AS part
      FROM (SELECT *, unnest(range(0, (len - 1) // 256 + 1)) AS t FROM contigs WHERE len > 0))"""],
        "SELECT contig, tile, greatest(length(part) - 5, 0) AS n_tokens, md5(coalesce(array_to_string(list_transform("
        "range(1, length(part) - 4), lambda i: substr(part, i, 6)), ' '), '')) AS digest FROM parts", ["n_tokens"]),
    "kmer_counts": query([CONTIGS],
        "SELECT substr(seq, i, 6) AS kmer, count(*) AS n FROM (SELECT seq, unnest(range(1, len - 4)) AS i "
        "FROM contigs) GROUP BY 1"),
    "tile_sequences": query([CONTIGS, _TILES],
        "SELECT contig, len AS length, tile, tile_start, tile_end, seq FROM tiles"),
    "tile_lines": query([CONTIGS, _TILES],
        "SELECT contig, len AS length, tile, tile_start, tile_end, seq FROM tiles"),
    "sliding_windows": query([CONTIGS, f"""starts AS MATERIALIZED (
      SELECT contig, '+' AS strand, j AS start, seq, len FROM (
        SELECT *, unnest(list_distinct(list_append(range(0, len - {W} + 1, 5), len - {W}))) AS j FROM contigs WHERE len > {W})
      UNION ALL
      SELECT contig, '-', len - {W} - j, seq, len FROM (
        SELECT *, unnest(list_distinct(list_append(range(0, len - {W} + 1, 5), len - {W}))) AS j FROM contigs WHERE len > {W})
      UNION ALL SELECT contig, unnest(['+', '-']), 0, seq, len FROM contigs WHERE len BETWEEN 1 AND {W}
    ), win AS MATERIALIZED (
      SELECT contig, strand, start, least(start + {W}, len) AS "end", {stranded(f'substr(seq, start + 1, {W})')} AS w FROM starts)"""],
        'SELECT contig, strand, count(*) AS n_windows, min(start) AS first_start, max(start) AS last_start, '
        'CAST(sum(start) AS BIGINT) AS sum_start, max("end") AS last_end, min(w) AS min_window, max(w) AS max_window '
        'FROM win GROUP BY contig, strand'),
    "lift_minus": query([CONTIGS],
        f'SELECT contig, j AS strand_start, len - {W} - j AS start, len - j AS "end" FROM (SELECT *, '
        f"unnest(list_distinct(list_append(range(0, len - {W} + 1, 5), len - {W}))) AS j FROM contigs WHERE len > {W})"),
    "lift_tiles": query([CONTIGS, _TILES],
        'SELECT contig, tile, tile_start, tile_start AS start, tile_end AS "end" FROM tiles'),
    "motif_hamming": query([CONTIGS],
        f"SELECT {ham('k7', K.C_BOX)} AS c_dist, {ham('k7', K.D_BOX)} AS d_dist, count(*) AS n FROM "
        "(SELECT substr(seq, i + 1, 7) AS k7 FROM (SELECT seq, unnest(range(0, len - 6)) AS i FROM contigs)) GROUP BY 1, 2"),
    "score_histogram": query([*SCAN_CTES, windows(5, None, "hits")],
        "SELECT strand, prob, label, count(*) AS n FROM hits GROUP BY ALL"),
    "positive_windows": query(positive(0.9), 'SELECT contig, strand, start, "end", prob FROM hits'),
    "islands": query([*positive(0.99, 1), islands("hits", "isl")],
        'SELECT contig, strand, start, "end", prob, head FROM isl'),
    "block_aggregate": query([*positive(0.99, 1), islands("hits", "isl"), blocks("isl", "blk")],
        "SELECT * FROM blk"),
    "merge_reciprocal": query(merged(0.9), "SELECT * FROM merged"),
    "long_blocks": query(merged(0.9), 'SELECT * FROM merged WHERE "end" - start >= 203 AND n_windows >= 3'),
    "centre_windows": query(centred(0.9), "SELECT * FROM centre"),
    "centre_membership": query(centred(0.9),
        'SELECT contig, start, "end", strand, block_id, present FROM centre_seen'),
    "centres_confirmed": query(centred(0.9), "SELECT * EXCLUDE (present) FROM centre_seen WHERE present"),
    "centres_unconfirmed": query(centred(0.9), "SELECT * EXCLUDE (present) FROM centre_seen WHERE NOT present"),
    "rescore_centres": query(confirmed(0.9), "SELECT * FROM kept"),
    "prediction_ids": query(found(0.9),
        'SELECT gene_id, contig, start, "end", strand, score, block_id, window_seq FROM cand'),
    "blocks_kept": query(confirmed(0.9),
        f'SELECT {block_id("m.")} AS block_id, m.* FROM merged m WHERE {block_id("m.")} IN (SELECT block_id FROM kept)'),
    "short_contigs": query([CONTIGS.replace("contigs AS", "whole AS", 1), """contigs AS MATERIALIZED (
      SELECT contig || '_' || (t * 190) AS contig, substr(seq, t * 190 + 1, 190) AS seq,
             length(substr(seq, t * 190 + 1, 190)) AS len
      FROM (SELECT *, unnest(range(0, (len - 1) // 190 + 1)) AS t FROM whole WHERE len > 0))""",
        POS, FRAMES, windows(5, 0.9, "hits"), SHORT], "SELECT * FROM short_kept"),
    "bed_centre": query([PEAKS, CENTRED_PEAKS.replace('WHERE start < "end" AND start >= 0', "")],
        'SELECT contig, start, "end", gene_id, score, strand FROM centred_peaks'),
    "bed_deduplicate": query([PEAKS, dedup("peaks", "u")],
        'SELECT contig, start, "end", gene_id, score, strand FROM u'),
    "rejected_peaks": query([*PREPARED[:4], dedup("centred_peaks", "u"), f"""named AS MATERIALIZED (
      SELECT row_no FROM (
        SELECT row_no, row_number() OVER (PARTITION BY gene_id ORDER BY row_no) AS a FROM centred_peaks) WHERE a = 1
    ), inside AS MATERIALIZED (
      SELECT row_no FROM (
        SELECT p.row_no, greatest(p.start - greatest(CAST(floor(({W} - (p."end" - p.start)) / 2) AS BIGINT), 0), 0) AS s,
          least(p."end" + greatest(CAST(ceil(({W} - (p."end" - p.start)) / 2) AS BIGINT), 0), t.len) AS e
        FROM u p JOIN contigs t ON t.contig = p.contig) WHERE s < e
    )"""], """SELECT row_no, gene_id, reason FROM (
        SELECT row_no, gene_id, CASE WHEN start >= "end" THEN 'start_not_before_end' WHEN start < 0 THEN 'negative_start'
          WHEN row_no NOT IN (SELECT row_no FROM named) THEN 'repeated_id'
          WHEN row_no NOT IN (SELECT row_no FROM u) THEN 'repeated_place'
          WHEN contig NOT IN (SELECT contig FROM contigs) THEN 'unknown_contig'
          WHEN row_no NOT IN (SELECT row_no FROM inside) THEN 'outside_contig' END AS reason
        FROM peaks) WHERE reason IS NOT NULL"""),
    "bed_prepare": query(PREPARED, 'SELECT contig, start, "end", gene_id, strand FROM prepared'),
    "bed_slop": query([CONTIGS, PEAKS],
        'SELECT p.row_no, p.contig, greatest(p.start - 30, 0) AS start, least(p."end" + 50, t.len) AS "end" '
        "FROM peaks p JOIN contigs t ON t.contig = p.contig"),
    "interval_sequence": query([CONTIGS, PEAKS],
        f"SELECT p.row_no, {stranded('substr(t.seq, p.start + 1, p.\"end\" - p.start)', 'p.strand')} AS sequence "
        'FROM peaks p JOIN contigs t ON t.contig = p.contig WHERE p.start < p."end" AND p.start < t.len'),
    "bed_scored": query(PREPARED,
        'SELECT contig, start, "end", gene_id, strand, p_pos, p_top, label FROM scored_peaks'),
    "bed_candidates": query(peak_candidates(0.9),
        'SELECT contig, start, "end", strand, score, window_seq, gene_id FROM cand'),
    "kmer_to_nt": query([*PREPARED, """vals AS MATERIALIZED (
      SELECT gene_id, strand, m, CASE WHEN substr(window_seq, m + 1, 1) = 'A' THEN 4.0 WHEN substr(window_seq, m + 6, 1) = 'C' THEN 1.0 ELSE 2.0 END AS v
      FROM (SELECT *, unnest(range(0, greatest(length(window_seq) - 5, 0))) AS m FROM prepared_seq)
    ), spots AS MATERIALIZED (
      SELECT gene_id, strand, m + d AS pos, avg(v) AS s FROM (SELECT *, unnest(range(0, 6)) AS d FROM vals) GROUP BY ALL)"""],
        "SELECT gene_id, strand, count(*) AS n, round(sum(s), 4) AS total, round(sum(s * (pos % 7)), 4) AS checksum "
        "FROM spots GROUP BY gene_id, strand"),
    "savgol_events": query([_EVENTS, _EV_SMOOTH], "SELECT id, seq_no, pos, n, round(s, 6) AS smoothed FROM evs"),
    "peaks_events": query([_EVENTS, _EV_SMOOTH],
        f"""SELECT id, seq_no, pos, round(s, 6) AS smoothed FROM (
              SELECT *, least(s - lag(s) OVER w, s - lead(s) OVER w) AS fall FROM evs WINDOW w AS (PARTITION BY id ORDER BY pos))
            WHERE pos > 0 AND pos < n - 1 AND s >= {K.PEAK_HEIGHT} AND round(fall, 9) >= {K.PEAK_DROP}"""),
    "occlusion_attribution": query([*CANDIDATES, *ATTRIBUTED],
        "SELECT a.gene_id, a.predicted_label, a.probability, s.pos, round(s.v, 8) AS value "
        "FROM attributed a JOIN signal s ON s.gene_id = a.gene_id", ["pos"]),
    "candidate_peaks": query([*CANDIDATES, *SIGNAL_PEAKS],
        "SELECT gene_id, pos, round(height, 7) AS height FROM signal_peaks", ["pos"]),
    "fuzzy_boxes": query([*CANDIDATES, BOX_HITS],
        """SELECT c.gene_id, any_value(a.start) AS c_start, any_value(a.cd) AS c_dist, any_value(b.start) AS d_start,
                  any_value(b.dd) AS d_dist, any_value(x.start) AS exact_d_start
           FROM cand c
           LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY gene_id ORDER BY cd, start) AS r FROM box_hits
                      WHERE start BETWEEN 21 AND 83 AND cd <= 3) a ON a.gene_id = c.gene_id AND a.r = 1
           LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY gene_id ORDER BY dd, start DESC) AS r FROM box_hits
                      WHERE start BETWEEN 113 AND 175 AND dd <= 2) b ON b.gene_id = c.gene_id AND b.r = 1
           LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY gene_id ORDER BY start DESC) AS r FROM box_hits
                      WHERE start BETWEEN 113 AND 175 AND dd = 0) x ON x.gene_id = c.gene_id AND x.r = 1
           GROUP BY c.gene_id""", ["c_start", "d_start", "exact_d_start"]),
    "boxes": query([*CANDIDATES, *BOXED, primes("cd")],
        """SELECT gene_id, substr(window_seq, cs, 7) AS c_motif, cs AS c_start, cdist AS c_dist,
                  substr(window_seq, ds, 4) AS d_motif, ds AS d_start, ddist AS d_dist,
                  substr(window_seq, cps, 7) AS c_prime_motif, cps AS c_prime_start, cpd AS c_prime_dist,
                  substr(window_seq, dps, 4) AS d_prime_motif, dps AS d_prime_start, dpd AS d_prime_dist,
                  c_limit, d_limit,
                  coalesce(cdist, 7) + coalesce(ddist, 4) + coalesce(cpd, 7) + coalesce(dpd, 4) AS box_score
           FROM primed""", ["c_start", "d_start", "c_prime_start", "d_prime_start", "c_limit", "d_limit"]),
    "prime_pairs": query([*PREPARED, _FIXED, _PEAK_BOXES, primes("fixed")],
        "SELECT gene_id, strand, cps AS c_prime_start, cpd AS c_prime_dist, dps AS d_prime_start, dpd AS d_prime_dist FROM primed", ["c_prime_start", "d_prime_start"]),
    "gene_limits": query([*CANDIDATES, *GENES_CTES],
        'SELECT gene_id, contig, gene_start AS start, gene_end AS "end", strand, predicted_sequence, predicted_extended_sequence FROM limited'),
    "gene_table": query([*CANDIDATES, *GENES_CTES], "SELECT * EXCLUDE (r) FROM genes", GENE_INTS),
    "genes_without_n": query([*CANDIDATES, *GENES_CTES],
        "SELECT gene_id, contig, start, \"end\", strand FROM genes WHERE NOT contains(predicted_sequence, 'N')"),
    "refinements": query([*CANDIDATES, REFINED], "SELECT * FROM refined"),
    "structure_features": query([*CANDIDATES, *GENES_CTES, FEATURES],
        "SELECT gene_id, normalized_sno_stability, terminal_combined, terminal_stem_score FROM featured"),
    "stem_flanks": query([*CANDIDATES, *BOXED, _FLANKED],
        f"SELECT gene_id, left_flank, right_flank, {stem_score('mark')} AS stem_length_score FROM (SELECT *, "
        f"{pairing('left_flank', 'right_flank', 'least(length(left_flank), length(right_flank))')} AS mark FROM flanked)", ["stem_length_score"]),
    "rule_cascade": query(LABELLED,
        "SELECT gene_id, probability_expressed_pseudogene, second_model_prediction, predicted_label FROM ruled"),
    "final_genes": query(LABELLED, "SELECT * FROM final", GENE_INTS),
    "final_first_model": query([*CANDIDATES, *GENES_CTES],
        f'SELECT gene_id, contig AS chr, start, "end", strand, probability_CD, box_score, {BOXES}, predicted_sequence '
        "FROM genes WHERE NOT contains(predicted_sequence, 'N')", GENE_INTS),
    "final_peaks": query([*peak_candidates(0.99), *GENES_CTES, REFINED, FEATURES, RULES, FINAL], "SELECT * FROM final", GENE_INTS),
    "bed_rows": query(LABELLED, _BED),
    "gtf_rows": query([*LABELLED, _BIOTYPES], _GTF),
    "fasta_records": query(LABELLED, f"SELECT gene_id, record FROM ({_RECORDS})"),
    "tsv_roundtrip": query([*CANDIDATES, *GENES_CTES],
        f'SELECT gene_id, contig AS chr, start, "end", strand, probability_CD, box_score, {BOXES}, predicted_sequence '
        "FROM genes WHERE NOT contains(predicted_sequence, 'N')", GENE_INTS),
    "label_joins": query([CONTIGS, """known AS MATERIALIZED (
      SELECT CAST(doc_id AS VARCHAR) AS contig, quality FROM labels)"""],
        "SELECT 'left' AS kind, c.contig, c.len AS length, k.quality FROM contigs c LEFT JOIN known k ON k.contig = c.contig "
        "UNION ALL SELECT 'semi', contig, len, NULL FROM contigs WHERE contig IN (SELECT contig FROM known) "
        "UNION ALL SELECT 'anti', contig, len, NULL FROM contigs WHERE contig NOT IN (SELECT contig FROM known)"),
}

_MASKED_CONTIGS = [CONTIGS.replace("contigs AS", "whole AS", 1), """contigs AS MATERIALIZED (
      SELECT contig, regexp_replace(seq, '[ACGT]', 'N', 'g') AS seq, len FROM whole)"""]
_ORDERED = 'ORDER BY chr, start, strand, "end", gene_id'


def _cells(*names: str) -> str:
    return " || chr(9) || ".join(names)


ORACLE |= {
    "narrow_windows": query(positive(0.9, width=NARROW), 'SELECT contig, strand, start, "end", prob FROM hits'),
    "narrow_centres": query(confirmed(0.9, NARROW), "SELECT * FROM kept"),
    "empty_result": query([*_MASKED_CONTIGS, *LABELLED[1:]], "SELECT * FROM final", GENE_INTS),
    "energies_table": query([*CANDIDATES, *GENES_CTES, FEATURES],
        "SELECT predicted_sequence AS sequence, lf || '&' || rf AS stem, any_value(ge) AS gene_energy, "
        "any_value(se) AS stem_energy, any_value(mark) AS pairing, "
        "CASE WHEN bool_or(strand = '+') THEN 1 ELSE 2 END AS round "
        "FROM featured WHERE predicted_sequence IS NOT NULL GROUP BY ALL"),
    "bed_file": query([*LABELLED, f"bed AS MATERIALIZED ({_BED})"],
        f"SELECT row_number() OVER ({_ORDERED}) AS line_no, "
        + _cells("chr", "start", '"end"', "gene_id", "empty_score", "strand", "attributes") + " AS value FROM bed"),
    "gtf_file": query([*LABELLED, _BIOTYPES, f"gtf AS MATERIALIZED ({_GTF})"],
        "SELECT row_number() OVER (ORDER BY chr, start, gene_id, "
        "CASE feature WHEN 'gene' THEN 0 WHEN 'transcript' THEN 1 ELSE 2 END) AS line_no, "
        + _cells("chr", "source", "feature", "start", '"end"', "score", "strand", "frame", "attributes") + " AS value FROM gtf"),
    "fasta_file": query([*LABELLED, f"""records AS MATERIALIZED (
      SELECT record, row_number() OVER ({_ORDERED}) AS nth FROM ({_RECORDS}))"""],
        "SELECT 2 * nth - 1 AS line_no, split_part(record, chr(10), 1) AS value FROM records "
        "UNION ALL SELECT 2 * nth, split_part(record, chr(10), 2) FROM records"),
}

# other plans for the same rows
ORACLE["short_contigs_small_tile"] = ORACLE["short_contigs"]
ORACLE["scan_user_scorer"] = ORACLE["positive_windows"]
