"""The queries in SQL, for another engine on the same tables."""

from __future__ import annotations

from ..functions.headers import ACCESSION_ENDS, ACCESSION_PREFIXES
from ..params import RANKS

_FROM, _TO = "abcdefghijklmnopqrstuvwxyz", "".join("ACGT"[i % 4] for i in range(26))
_DNA = "regexp_replace(translate(lower({x}), '" + _FROM + "', '" + _TO + "'), '[^ACGT]', '', 'g')"

_TARGETS = f"""targets AS (SELECT doc_id AS tgt, 'doc_' || doc_id AS name, -doc_id-1 AS taxid, lang, source, {_DNA.format(x='text')} AS dna FROM documents)"""
_READS = f"""reads AS (SELECT item_id+1 AS query_id, 'read_' || item_id || ' item' AS header, {_DNA.format(x='text')} AS seq1, '' AS seq2 FROM benchmark)"""
_PAIRS = f"""reads AS (SELECT a.item_id//2+1 AS query_id, {_DNA.format(x='a.text')} AS seq1, {_DNA.format(x='b.text')} AS seq2 FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id+1 WHERE a.item_id % 2 = 0)"""


def _code(c: str, k: int) -> str:
    return f"list_reduce(list_transform(range(1,{k + 1}), lambda i: (strpos('ACGT', substr({c}, i::int, 1))-1)::bigint), lambda a, b: a*4+b)"


def _hash(c: str) -> str:
    x = f"({c})"
    for _ in range(2):
        x = f"((xor({x} >> 16, {x}) * 73244475) & 4294967295)"
    return f"xor({x} >> 16, {x})"


def _windows(name: str, seqs: str, k: int = 10) -> str:
    t = 128 - k + 1
    n = f"(CASE WHEN len_ <= 128 THEN 1 ELSE (len_-128)//{t} + 1 + CASE WHEN ((len_-128)//{t} + 1)*{t} < len_ THEN 1 ELSE 0 END END)"
    return f"""{name} AS (SELECT id, w::int AS win, substr(seq, w::int*{t}+1, 128) AS s FROM (SELECT id, seq, unnest(range({n})) AS w FROM (SELECT id, seq, length(seq) AS len_ FROM ({seqs}) WHERE length(seq) > 0)))"""


def _sketch(name: str, windows: str, k: int = 10) -> str:
    """Distinct k-mers first, so that each is hashed once."""
    return f"""{name}_k AS (SELECT DISTINCT id, win, substr(s, i::int, {k}) AS km FROM (SELECT id, win, s, unnest(range(1, length(s)-{k}+2)) AS i FROM {windows} WHERE length(s) >= {k})),
{name}_c AS (SELECT DISTINCT id, win, least(km, translate(reverse(km), 'ACGT', 'TGCA')) AS c FROM {name}_k),
{name}_u AS (SELECT c, {_code('c', k)} AS x FROM (SELECT DISTINCT c FROM {name}_c)),
{name}_v AS (SELECT c, x0, (xor(x0 >> 16, x0) * 73244475) & 4294967295 AS x1 FROM (SELECT c, x AS x0 FROM {name}_u)),
{name}_w AS (SELECT c, (xor(x1 >> 16, x1) * 73244475) & 4294967295 AS x2 FROM {name}_v),
{name}_h AS (SELECT id, win, xor(x2 >> 16, x2) AS feature FROM {name}_c JOIN {name}_w USING (c)),
{name} AS (SELECT id, win, feature FROM (SELECT *, row_number() OVER (PARTITION BY id, win ORDER BY feature) AS n FROM {name}_h WHERE feature <> 4294967295) WHERE n <= 16)"""


def _wide_sketch(windows: str, k: int) -> str:
    """Hashes of 64 bits, unsigned until the features are chosen; products in 128 bits."""
    times = lambda x, c: f"((({x})::uhugeint * {c}::uhugeint) % 18446744073709551616::uhugeint)::ubigint"
    shifted = "xor(x, x >> 33)"
    return f"""ws_k AS (SELECT DISTINCT id, win, substr(s, i::int, {k}) AS km FROM (SELECT id, win, s, unnest(range(1, length(s)-{k}+2)) AS i FROM {windows} WHERE length(s) >= {k})),
ws_c AS (SELECT DISTINCT id, win, least(km, translate(reverse(km), 'ACGT', 'TGCA')) AS c FROM ws_k),
ws_1 AS (SELECT c, ({_code('c', k)})::ubigint AS x FROM (SELECT DISTINCT c FROM ws_c)),
ws_2 AS (SELECT c, {times(shifted, 0xFF51AFD7ED558CCD)} AS x FROM ws_1),
ws_3 AS (SELECT c, {times(shifted, 0xC4CEB9FE1A85EC53)} AS x FROM ws_2),
ws_4 AS (SELECT c, {shifted} AS x FROM ws_3),
ws AS (SELECT id, win, CASE WHEN x >= 9223372036854775808::ubigint THEN (x::hugeint - 18446744073709551616::hugeint)::bigint ELSE x::bigint END AS feature
 FROM (SELECT *, row_number() OVER (PARTITION BY id, win ORDER BY x) AS n FROM ws_c JOIN ws_4 USING (c) WHERE x <> 18446744073709551615::ubigint) WHERE n <= 16)"""


def _syncmers(windows: str, k: int = 10) -> str:
    """Distinct k-mers whose first or last inner k-mer has the smallest hash."""
    s = k // 2
    inner = f"list_transform(range(1, {k - s + 2}), lambda i: least(substr(c, i::int, {s}), translate(reverse(substr(c, i::int, {s})), 'ACGT', 'TGCA')))"
    return f"""sy_k AS (SELECT DISTINCT id, win, substr(s, i::int, {k}) AS km FROM (SELECT id, win, s, unnest(range(1, length(s)-{k}+2)) AS i FROM {windows} WHERE length(s) >= {k})),
sy_c AS (SELECT DISTINCT id, win, least(km, translate(reverse(km), 'ACGT', 'TGCA')) AS c FROM sy_k),
sy_i AS (SELECT c, generate_subscripts(l, 1) AS i, unnest(l) AS m FROM (SELECT c, {inner} AS l FROM (SELECT DISTINCT c FROM sy_c))),
sy_m AS (SELECT m, {_hash(_code('m', s))} AS h FROM (SELECT DISTINCT m FROM sy_i)),
sy_o AS (SELECT c FROM sy_i JOIN sy_m USING (m) GROUP BY 1 HAVING min(h) IN (arg_min(h, i), arg_max(h, i))),
sy_h AS (SELECT c, {_hash(_code('c', k))} AS feature FROM sy_o),
sy AS (SELECT id, win, feature FROM (SELECT *, row_number() OVER (PARTITION BY id, win ORDER BY feature) AS n FROM sy_c JOIN sy_h USING (c) WHERE feature <> 4294967295) WHERE n <= 16)"""


def _index(k: int = 10) -> str:
    return f"""{_TARGETS}, {_windows('tw', 'SELECT tgt AS id, dna AS seq FROM targets', k)}, {_sketch('ts', 'tw', k)}, idx AS (SELECT feature, id AS tgt, win FROM ts)"""


_CAPPED = "capped AS (SELECT feature, tgt, win FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY tgt, win) AS n FROM idx) WHERE n <= 254)"


def _features(reads: str) -> str:
    return f"""{reads}, {_windows('q1', 'SELECT query_id AS id, seq1 AS seq FROM reads')}, {_windows('q2', 'SELECT query_id AS id, seq2 AS seq FROM reads')},
{_sketch('s1', 'q1')}, {_sketch('s2', 'q2')}, qf AS (SELECT id AS query_id, feature, count(*) AS n FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2) GROUP BY 1, 2)"""


_HITS_END = "hits AS (SELECT query_id, tgt, win, sum(n)::bigint AS hits FROM qf JOIN capped USING (feature) GROUP BY 1, 2, 3)"


def _hits(reads: str = _READS) -> str:
    return f"{_index()}, {_CAPPED}, {_features(reads)}, {_HITS_END}"


def _ranges(insert: int = 0) -> str:
    return f"""spans AS (SELECT query_id, (2 + greatest(length(seq1) + length(seq2), {insert}) // 119)::int AS span FROM reads),
ranges AS (SELECT l.query_id, l.tgt, min(r.win) AS beg, l.win AS "end", sum(r.hits)::bigint AS hits FROM hits l JOIN spans USING (query_id) JOIN hits r ON r.query_id = l.query_id AND r.tgt = l.tgt AND r.win <= l.win AND r.win > l.win - span GROUP BY l.query_id, l.tgt, l.win)"""


_BEST = """best AS (SELECT query_id, tgt, beg, "end", hits FROM (SELECT *, row_number() OVER (PARTITION BY query_id, tgt ORDER BY hits DESC, "end") AS n FROM ranges) WHERE n = 1)"""
_LANG_ID = "((ascii(lang) - 97 + 26 * (ascii(substr(lang, 2, 1)) - 97) + 1)::bigint * 1000)"
_SPECIES_ID = f"({_LANG_ID} + regexp_extract(source, '([0-9]+)', 1)::bigint + 1)"
_TAXA = f"""taxa AS (SELECT 1::bigint AS taxid, 1::bigint AS parent, 'root' AS name, 20 AS rank
 UNION ALL SELECT DISTINCT {_LANG_ID}, 1, lang, 19 FROM documents
 UNION ALL SELECT DISTINCT {_SPECIES_ID}, {_LANG_ID}, lang || ' ' || source, 4 FROM documents
 UNION ALL SELECT -doc_id-1, {_SPECIES_ID}, 'doc_' || doc_id, 0 FROM documents)"""
_GEO = """taxa AS (SELECT 1::bigint AS taxid, 1::bigint AS parent, 'root' AS name, 20 AS rank
 UNION ALL SELECT r_regionkey+10, 1, r_name, 19 FROM region
 UNION ALL SELECT n_nationkey+100, n_regionkey+10, n_name, 16 FROM nation
 UNION ALL SELECT s_suppkey+1000000, s_nationkey+100, s_name, 4 FROM supplier
 UNION ALL SELECT c_custkey+2000000, c_nationkey+100, c_name, CASE WHEN c_custkey % 7 = 0 THEN 21 ELSE 4 END FROM customer)"""
_LIN = """lin_(taxid, anc, depth, rank, parent) AS (SELECT taxid, taxid, 0, rank, parent FROM taxa
 UNION ALL SELECT l.taxid, t.taxid, l.depth+1, t.rank, t.parent FROM lin_ l JOIN taxa t ON t.taxid = l.parent WHERE l.parent <> l.anc),
lin AS (SELECT taxid, anc, depth, rank FROM lin_),
ranked AS (SELECT taxid, rank, arg_max(anc, depth) AS anc FROM lin WHERE rank < 21 GROUP BY 1, 2)"""


def _cands(rank: int, most: int) -> str:
    own = "taxon_of AS (SELECT tgt, taxid FROM targets)" if rank == 0 else f"taxon_of AS (SELECT t.tgt, coalesce(r.anc, t.taxid) AS taxid FROM targets t LEFT JOIN ranked r ON r.taxid = t.taxid AND r.rank = {rank})"
    return f"""{own},
per AS (SELECT query_id, taxid, tgt, hits, beg, "end" FROM (SELECT *, row_number() OVER (PARTITION BY query_id, taxid ORDER BY hits DESC, tgt) AS n FROM best JOIN taxon_of USING (tgt)) WHERE n = 1),
cand AS (SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, tgt))::int AS pos FROM per) WHERE pos <= {most})"""


def _classify(low: int, diff: float, highest: int = 19, cand: str = "cand") -> str:
    return f"""used AS (SELECT query_id, pos, taxid, count(*) OVER (PARTITION BY query_id) AS n FROM (SELECT *, max(hits) OVER (PARTITION BY query_id) AS top FROM {cand}) WHERE top >= {low} AND (pos = 1 OR hits > CASE WHEN top > {low} THEN (top-{low})*{diff} ELSE 0 END)),
shared AS (SELECT u.query_id, r.rank, min(r.anc) AS anc FROM used u JOIN ranked r USING (taxid) WHERE u.n > 1 GROUP BY u.query_id, r.rank, u.n HAVING count(*) = u.n AND min(r.anc) = max(r.anc)),
low AS (SELECT query_id, min(rank) AS rank, arg_min(anc, rank) AS taxid FROM shared GROUP BY 1 UNION ALL SELECT query_id, t.rank, taxid FROM used JOIN taxa t USING (taxid) WHERE n = 1),
cls_ AS (SELECT query_id, taxid, rank FROM low WHERE rank <= {highest})"""


def _classified(low: int = 5, diff: float = 1.0, rank: int = 0, most: int = 2) -> str:
    return f"{_hits()}, {_ranges()}, {_BEST}, {_TAXA}, {_LIN}, {_cands(rank, most)}, {_classify(low, diff)}, cls AS (SELECT r.query_id, c.taxid, c.rank FROM reads r LEFT JOIN cls_ c USING (query_id))"


_C4 = {"low": 4, "diff": 0.8, "rank": 4, "most": 4}
_TRUTH = "truth AS (SELECT item_id+1 AS query_id, CASE WHEN item_id % 5 <> 4 THEN -3*item_id-1 END AS truth_taxid FROM benchmark)"
_HEADERS = """headers AS (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'NC_' || lpad(doc_id::varchar, 6, '0') || '.2 some words' WHEN 1 THEN 'gi|' || doc_id || '|ref|NZ_AB' || doc_id || '.1| name' WHEN 2 THEN 'GCF_' || doc_id || '-x_y.3' WHEN 3 THEN 'contig' || doc_id || ' taxid|' || doc_id || ' end' WHEN 4 THEN 'gi|' || doc_id || ' no number' WHEN 5 THEN 'plain' || doc_id WHEN 6 THEN 'AE' || doc_id || ' taxid:12x|z' ELSE '' END AS header FROM documents)"""


def _find(text: str, what: str, start: str = "1") -> str:
    """Place of what at or after start, 0 if there is none."""
    return f"(CASE WHEN strpos(substr({text}, {start}), '{what}') > 0 THEN strpos(substr({text}, {start}), '{what}') + {start} - 1 ELSE 0 END)"


def _end(text: str, start: str) -> str:
    when = " ".join(f"WHEN {start} <= length({text}) AND {_find(text, e, start)} > 0 THEN {_find(text, e, start)}" for e in ACCESSION_ENDS)
    return f"(CASE {when} ELSE length({text}) + 1 END)"


def _accver(h: str) -> str:
    def known(p: str) -> str:
        i, n = _find(h, p), len(p)
        dot = _find(h, ".", f"({i} + {n})")
        return f"CASE WHEN {i} > 0 AND {dot} > 0 AND {dot} - {i} <= 25 THEN nullif(trim(substr({h}, {i}, {_end(h, f'({dot} + 1)')} - {i})), '') END"

    dot = _find(h, ".", "2")
    plain = f"CASE WHEN {dot} > 0 AND {dot} - 1 < 25 THEN nullif(trim(substr({h}, 1, {_end(h, f'({dot} + 1)')} - 1)), '') END"
    return f"(CASE WHEN length({h}) >= 2 THEN coalesce({', '.join([*map(known, ACCESSION_PREFIXES), plain])}, '') ELSE '' END)"


def _acc(h: str) -> str:
    def known(p: str) -> str:
        i, n = _find(h, p), len(p)
        end, dot = _end(h, f"({i} + {n})"), _find(h, ".", f"({i} + {n})")
        return f"CASE WHEN {i} > 0 THEN nullif(trim(substr({h}, {i}, (CASE WHEN {dot} > 0 AND {dot} < {end} THEN {dot} ELSE {end} END) - {i})), '') END"

    return f"coalesce({', '.join(map(known, ACCESSION_PREFIXES))}, '')"


def _until(h: str, i: str, skip: int) -> str:
    bar, blank = _find(h, "|", f"({i} + {skip})"), _find(h, " ", f"({i} + {skip})")
    return f"(CASE WHEN {bar} > 0 THEN {bar} WHEN {blank} > 0 THEN {blank} ELSE length({h}) + 1 END)"


_GI = f"(CASE WHEN strpos(header, 'gi|') > 0 THEN trim(substr(header, strpos(header, 'gi|') + 3, {_until('header', 'strpos(header, $$gi|$$)', 3)} - strpos(header, 'gi|') - 3)) ELSE '' END)"
_TAXID = f"(CASE WHEN strpos(header, 'taxid') > 0 THEN coalesce(try_cast(nullif(regexp_extract(substr(header, strpos(header, 'taxid') + 6, {_until('header', 'strpos(header, $$taxid$$)', 6)} - strpos(header, 'taxid') - 6), '^\\s*\\+?([0-9]+)', 1), '') AS bigint), 0) ELSE 0 END)::bigint"
_STATS = f"""d AS (SELECT coalesce(c.rank, 21) AS a, coalesce(k.rank, 21) AS k, coalesce((SELECT min(x.rank) FROM ranked x JOIN ranked y ON x.rank = y.rank AND x.anc = y.anc WHERE x.taxid = c.taxid AND y.taxid = t.truth_taxid), 21) AS l
 FROM cls c LEFT JOIN truth t USING (query_id) LEFT JOIN taxa k ON k.taxid = t.truth_taxid),
e AS (SELECT a, k, greatest(a, k, l) AS c FROM d), ranks AS (SELECT unnest(range(22))::int AS rank),
st AS (SELECT rank, count(*) FILTER (a <= rank AND (rank < 21) = (a < 21))::bigint AS assigned, count(*) FILTER (k <= rank AND (rank < 21) = (k < 21))::bigint AS known,
 count(*) FILTER (k < 21 AND c <= rank AND (rank < 21) = (c < 21))::bigint AS correct, count(*) FILTER (k < 21 AND c > k AND c > a AND rank < c)::bigint AS wrong FROM e, ranks GROUP BY rank)"""


def _moments(value: str, source: str) -> str:
    kurt = f"kurtosis_pop({value})"
    return f"""SELECT count(*)::bigint AS n, sum({value}) AS total, max({value}) AS largest, round(avg({value}), 6) AS mean, round(stddev_samp({value}), 6) AS stddev, round((sum(power({value} - m, 3)) / count(*)) / power(var_samp({value}), 1.5), 6) AS skewness, round({kurt}, 6) AS kurtosis FROM (SELECT {value}, avg({value}) OVER () AS m FROM {source})"""


_ALIGNED = f"""{_hits()}, {_ranges()}, {_BEST}, one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, tgt) AS n FROM best) WHERE n = 1),
pairs AS MATERIALIZED (SELECT query_id, tgt, seq1, substr(dna, (beg*119+1)::int, (("end"-beg)*119+128)::int) AS part FROM one JOIN reads USING (query_id) JOIN targets USING (tgt)),
strands AS MATERIALIZED (SELECT query_id, 0 AS rc, seq1 AS q, part FROM pairs UNION ALL SELECT query_id, 1, translate(reverse(seq1), 'ACGT', 'TGCA'), part FROM pairs),
dp(query_id, rc, i, j, s) AS (SELECT query_id, rc, 0, j, 0 FROM (SELECT *, unnest(range(length(part)+1))::int AS j FROM strands)
 UNION ALL SELECT query_id, rc, i, j, max(up + j) OVER (PARTITION BY query_id, rc ORDER BY j) - j FROM (
  SELECT d.query_id, d.rc, d.i+1 AS i, d.j, CASE WHEN d.j = 0 THEN 0 ELSE greatest(lag(d.s) OVER (PARTITION BY d.query_id, d.rc ORDER BY d.j) + CASE WHEN substr(b.q, d.i+1, 1) = substr(b.part, d.j, 1) THEN 2 ELSE -1 END, d.s - 1) END AS up
  FROM dp d JOIN strands b ON b.query_id = d.query_id AND b.rc = d.rc WHERE d.i < length(b.q)))"""


def _states(value: str, source: str, key: str = "") -> str:
    """Moments straight from values: differences from the mean of all, or of those with the same key."""
    over, own, group = (f"PARTITION BY {key}", f"{key}, ", f" GROUP BY {key}") if key else ("", "", "")
    return f"""SELECT {own}count(*)::bigint AS n, round(sum(v), 5) AS total, round(avg(v), 5) AS mean, round(var_samp(v), 5) AS variance, round(stddev_samp(v), 5) AS stddev,
 round(avg(power(v - m, 3)) / power(var_samp(v), 1.5), 5) AS skewness, round(avg(power(v - m, 4)) / power(var_pop(v), 2), 5) AS kurtosis, round(avg(power(v - m, 4)) / power(var_pop(v), 2) - 3, 5) AS excess,
 round(avg(v*v), 5) AS raw2, round(avg(v*v*v), 5) AS raw3, round(avg(v*v*v*v), 5) AS raw4 FROM (SELECT *, avg(v) OVER ({over}) AS m FROM (SELECT *, ({value})::double AS v FROM {source})){group}"""


def _with(ctes: str, body: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{body}"


def _hash_sql() -> str:
    """Layer by layer, so that each value is computed once; products in 128 bits."""
    wide = lambda x: f"(({x}) % 18446744073709551616::uhugeint)::ubigint"
    times = lambda x, c: wide(f"{x}::uhugeint * {c}::uhugeint")
    plus = lambda *a: wide(" + ".join(f"{x}::uhugeint" for x in a))
    low = lambda x: f"({x}) % 4294967296"
    shifted = lambda v, n: f"xor({v}, {v} >> {n})"
    layers = [
        {"m": "x", "p": "x", "h": plus("(18446744073709551615::ubigint - x)", times("x", 1 << 18)), "y": low("x")},
        {"m": times(shifted("m", 33), 0xFF51AFD7ED558CCD), "p": times(shifted("p", 30), 0xBF58476D1CE4E5B9), "h": times(shifted("h", 31), 21), "y": low(f"y + {0x7ED55D16} + y * {1 << 12}")},
        {"m": times(shifted("m", 33), 0xC4CEB9FE1A85EC53), "p": times(shifted("p", 27), 0x94D049BB133111EB), "h": shifted("h", 11), "y": f"xor(xor(y, {0xC761C23C}::ubigint), y >> 19)"},
        {"m": shifted("m", 33), "p": shifted("p", 31), "h": plus("h", times("h", 1 << 6)), "y": low(f"y + {0x165667B1} + y * {1 << 5}")},
        {"m": "m", "p": "p", "h": low(shifted("h", 22)), "y": f"xor({low(f'y + {0xD3A2646C}')}, {low(f'y * {1 << 9}')})"},
        {"m": "m", "p": "p", "h": "h", "y": low(f"y + {0xFD7046C5} + y * {1 << 3}")},
        {"m": "m", "p": "p", "h": "h", "y": f"xor(xor(y, {0xB55A4F09}::ubigint), y >> 16)"},
    ]
    q = "SELECT o_orderkey, (o_orderkey * 1000003000007 + o_custkey)::ubigint AS x FROM orders"
    for i, own in enumerate(layers):
        q = f"SELECT o_orderkey, {', '.join(f'({v})::ubigint AS {k}' for k, v in own.items())} FROM ({q}) l{i}"
    signed = lambda v: f"CASE WHEN {v} >= 9223372036854775808::ubigint THEN ({v}::hugeint - 18446744073709551616::hugeint)::bigint ELSE {v}::bigint END"
    return f"SELECT o_orderkey, {signed('m')} AS murmur64, {signed('p')} AS splitmix64, h::bigint AS halved, y::bigint AS six_rounds FROM ({q}) z"


_RECORDS = f"""{_TARGETS}, recs AS (SELECT tgt, (tgt // 4096)::int AS f, 'NC_' || tgt || '.1 ' || name || ' taxid:' || {_SPECIES_ID} AS header, dna FROM targets WHERE length(dna) > 0)"""
_RANK_NAME = "CASE {r} " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(RANKS)) + " END"
_BAR = "chr(9) || '|' || chr(9)"
#: Windows of a target.
_N_WINDOWS = "(CASE WHEN length(dna) <= 128 THEN 1 ELSE (length(dna)-128)//119 + 1 + CASE WHEN ((length(dna)-128)//119 + 1)*119 < length(dna) THEN 1 ELSE 0 END END)"


def _file_sql() -> dict[str, str]:
    """Of the queries that go through files."""
    reads = f"r AS (SELECT item_id AS o, 'read_' || item_id || ' item' AS header, {_DNA.format(x='text')} AS data FROM benchmark)"
    th = "th AS (SELECT query_id, string_agg(taxid || ':' || hits, ',' ORDER BY pos) AS top_hits FROM cand GROUP BY 1)"
    lineage = f"""texts AS (SELECT l.taxid, string_agg({_RANK_NAME.format(r='x.rank')} || ':' || coalesce(t.name, '--') || '(' || coalesce(r.anc, 0) || ')', ',' ORDER BY x.rank) AS text
 FROM (SELECT DISTINCT taxid, rank FROM cls WHERE taxid IS NOT NULL) l JOIN (SELECT unnest(range(4, 20))::int AS rank) x ON x.rank >= l.rank LEFT JOIN ranked r ON r.taxid = l.taxid AND r.rank = x.rank LEFT JOIN taxa t ON t.taxid = r.anc GROUP BY 1)"""
    pct = lambda a, b: f"round(100 * ({a} / {b}), 6)::varchar || '%'"
    name = f"rpad({_RANK_NAME.format(r='rank')}, 11, ' ')"
    shown = "rank IN (0, 3, 4, 6, 10, 12, 14, 16, 18, 19, 20) AND assigned > 0"
    parts = [
        f"SELECT 0 AS k, 1 AS o, rank, 'unclassified: ' || {pct('assigned', 'total')} || ' (' || assigned || ')' AS t FROM st, tot WHERE rank = 21 AND assigned > 0",
        "SELECT 1, 0, -1, 'classified:'",
        f"SELECT 1, 1, rank, '  ' || {name} || {pct('assigned', 'total')} || ' (' || assigned || ')' FROM st, tot WHERE {shown}",
        f"SELECT 2, 1, rank, 'without a known origin: ' || {pct('known', 'total')} || ' (' || known || ')' FROM st, tot WHERE rank = 21 AND known > 0",
        "SELECT 3, 0, -1, 'with a known origin:'",
        f"SELECT 3, 1, rank, '  ' || {name} || {pct('known', 'total')} || ' (' || known || ')' FROM st, tot WHERE {shown}",
        "SELECT 4, 0, -1, 'placed as their origin says:'",
        f"SELECT 4, 1, rank, '  ' || {name} || correct FROM st WHERE {shown}",
        "SELECT 5, 0, -1, 'right among those placed (origin known):'",
        f"SELECT 5, 1, rank, '  ' || {name} || coalesce(CASE WHEN correct + wrong > 0 THEN {pct('correct', '(correct + wrong)')} END, '0.0%') FROM st WHERE {shown}",
        "SELECT 6, 0, -1, 'right among all (origin known):'",
        f"SELECT 6, 1, rank, '  ' || {name} || coalesce(CASE WHEN known > 0 THEN {pct('correct', 'known')} END, '0.0%') FROM st WHERE {shown}",
    ]
    return {
        "read_fasta_records": _with(_RECORDS, 'SELECT f, row_number() OVER (PARTITION BY f ORDER BY tgt) AS "index", header, dna AS data FROM recs'),
        "read_from_record": _with(_RECORDS, 'SELECT * FROM (SELECT f, row_number() OVER (PARTITION BY f ORDER BY tgt) AS "index", header, dna AS data FROM recs) WHERE "index" >= 5'),
        "read_headers_only": _with(_RECORDS, 'SELECT f, row_number() OVER (PARTITION BY f ORDER BY tgt) AS "index", header FROM recs'),
        "read_fastq_records": _with(reads, 'SELECT row_number() OVER (ORDER BY o) AS "index", header, data, length(data) AS n_qualities FROM r'),
        "read_mixed_files": _with(reads, """SELECT CASE o % 3 WHEN 0 THEN 'x.fna' WHEN 1 THEN 'y.fnq' ELSE 'z' END AS name, row_number() OVER (PARTITION BY o % 3 ORDER BY o) AS "index", header, data FROM r"""),
        "read_paired_files": _with(reads, "SELECT a.o // 2 + 1 AS query_id, a.header, a.data AS seq1, b.data AS seq2 FROM r a JOIN r b ON b.o = a.o + 1 WHERE a.o % 2 = 0 AND a.o // 2 < 15"),
        "read_consecutive_mates": _with(reads, "SELECT a.o // 2 + 1 AS query_id, a.header, a.data AS seq1, b.data AS seq2 FROM r a JOIN r b ON b.o = a.o + 1 WHERE a.o % 2 = 0"),
        "taxonomy_dumps": _with(_GEO, "SELECT taxid, parent, name, rank FROM taxa UNION ALL SELECT s_suppkey + 9000000, s_suppkey + 1000000, '', 21 FROM supplier"),
        "accession_mapping": _with(_RECORDS, "SELECT 'NC_' || tgt AS acc, 'NC_' || tgt || '.1' AS accver, tgt * 10 + i AS taxid, tgt::varchar AS gi FROM recs, (SELECT unnest([0, 1]) AS i) WHERE tgt % 2 = 0"),
        "assembly_summary": "SELECT 'GCF_' || p_partkey AS key, p_partkey * 2 AS taxid FROM part",
        "annotate_file": _with(_RECORDS, """SELECT row_number() OVER (ORDER BY tgt) AS "index", '>NC_' || tgt || '.1 taxid|' || CASE WHEN tgt % 2 = 0 THEN tgt * 10 ELSE 0 END || ' doc_' || tgt AS value FROM recs"""),
        "build_mode": _with(f"{_RECORDS}, s AS (SELECT doc_id AS tgt, {_SPECIES_ID} AS parent FROM documents)", f"SELECT row_number() OVER (ORDER BY tgt) - 1 AS tgt, 'NC_' || tgt || '.1' AS name, parent, {_N_WINDOWS}::bigint AS windows FROM recs JOIN s USING (tgt)"),
        "build_mode_features": _with(f"{_index()}, {_CAPPED}, own AS (SELECT tgt, row_number() OVER (ORDER BY tgt) - 1 AS n FROM targets WHERE length(dna) > 0)", "SELECT own.n AS tgt, count(*)::bigint AS n, sum(feature)::bigint AS total FROM capped JOIN own USING (tgt) GROUP BY 1"),
        "info_mode": _with(f"{_index()}, {_CAPPED}, {_TAXA}, fc AS (SELECT count(*) AS n FROM capped GROUP BY feature), own AS (SELECT count(*) AS n FROM targets WHERE length(dna) > 0)", "SELECT 10 AS k, 16 AS size, 128 AS window, 119 AS stride, 254 AS max_locations, count(*)::bigint AS n, sum(n)::bigint AS total, max(n) AS largest, round(avg(n), 6) AS mean, (SELECT n FROM own) AS targets, (SELECT n FROM own) AS ranked_targets, (SELECT count(*) FROM taxa WHERE rank > 0) AS taxa FROM fc"),
        "modify_mode": _with(
            f"{_index()}, s AS (SELECT doc_id AS tgt, {_SPECIES_ID} AS parent FROM documents), numbered AS (SELECT tgt, row_number() OVER (ORDER BY tgt % 2, tgt) AS k FROM targets WHERE length(dna) > 0), kept AS (SELECT feature, tgt FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY k, win) AS n FROM idx JOIN numbered USING (tgt)) WHERE n <= 254)",
            "SELECT 'NC_' || tgt || '.1' AS name, parent, coalesce(c.n, 0) AS n FROM numbered JOIN s USING (tgt) LEFT JOIN (SELECT tgt, count(*) AS n FROM kept GROUP BY 1) c USING (tgt)",
        ),
        "query_mode": _with(_classified(**_C4), "SELECT query_id, taxid, rank FROM cls"),
        "merge_mode": _with(_classified(**_C4), "SELECT query_id, taxid, rank FROM cls WHERE query_id IN (SELECT query_id FROM cand)"),
        "result_file": _with(_classified(**_C4), "SELECT query_id, split_part(header, ' ', 1) AS header, pos - 1 AS pos, taxid, hits FROM cand JOIN reads USING (query_id)"),
        "lineage_report": _with(f"{_classified(**_C4)}, {th}, {lineage}", f"SELECT query_id, query_id || {_BAR} || split_part(header, ' ', 1) || {_BAR} || coalesce(top_hits, '') || {_BAR} || coalesce(text, '--') AS line FROM cls JOIN reads USING (query_id) LEFT JOIN th USING (query_id) LEFT JOIN texts USING (taxid)"),
        "separate_columns_report": _with(
            f"{_classified()}, th AS (SELECT query_id, string_agg('NC_' || tgt || '.1:' || hits, ',' ORDER BY pos) AS top_hits FROM cand GROUP BY 1)",
            f"SELECT query_id, split_part(header, ' ', 1) || {_BAR} || coalesce(top_hits, '') || {_BAR} || CASE WHEN c.taxid IS NULL THEN '--' ELSE CASE WHEN c.taxid < 0 THEN 'NC_' || (-c.taxid-1) || '.1' ELSE t.name END END || {_BAR} || coalesce(c.taxid, 0) AS line FROM cls c JOIN reads USING (query_id) LEFT JOIN th USING (query_id) LEFT JOIN taxa t ON t.taxid = c.taxid",
        ),
        "hits_per_target_report": _with(
            f"{_hits()}, one AS (SELECT tgt, query_id, query_id || '/' || string_agg(win || ':' || hits, '/' ORDER BY win) AS one, min(win) AS a, max(win) AS z FROM hits GROUP BY 1, 2)",
            f"SELECT tgt, 0 AS pos, 'sequence:NC_' || tgt || '.1' || {_BAR} || any_value({_N_WINDOWS}) || {_BAR} || string_agg(one, ',' ORDER BY a, z, query_id) AS line FROM one JOIN targets USING (tgt) GROUP BY 1",
        ),
        "summary_report": _with(f"{_classified(**_C4)}, {_TRUTH}, {_STATS}, tot AS (SELECT sum(assigned) FILTER (rank >= 20) AS total FROM st), l AS ({' UNION ALL '.join(parts)})", "SELECT (row_number() OVER (ORDER BY k, o, rank))::int AS pos, '# ' || t AS line FROM l"),
        "modify_removed": _with(_index(8), "SELECT 'NC_' || tgt || '.1' AS name, count(*)::bigint AS n, sum(feature)::bigint AS total FROM (SELECT *, count(*) OVER (PARTITION BY feature) AS c FROM idx) WHERE c <= 253 GROUP BY tgt"),
        "taxa_edits": _with(_GEO, "SELECT t.taxid, CASE WHEN n_name IS NOT NULL THEN 1 WHEN s_suppkey IS NOT NULL THEN s_nationkey % 5 + 100 ELSE parent END AS parent, coalesce(upper(n_name), name) AS name, rank FROM taxa t LEFT JOIN nation ON n_nationkey + 100 = t.taxid LEFT JOIN supplier ON s_suppkey + 1000000 = t.taxid WHERE rank <= 16"),
    }


def oracle_sql() -> dict[str, str]:
    n_text = "regexp_replace(translate(lower(text), '" + _FROM + "', '" + _TO + "'), '[^ACGT]', 'N', 'g')"
    rounded = lambda *c: ", ".join(f"round({x}, 6) AS {x}" for x in c)
    murmur = "xor(y3 >> 16, y3)"
    geo_pairs = "pairs AS (SELECT DISTINCT o_custkey+2000000 AS a, l_suppkey+1000000 AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"
    share = lambda a, b, n: f"round(CASE WHEN {b} > 0 THEN ({a}) / ({b}) END, 6) AS {n}"
    return {
        "seq_windows": _with(f"{_TARGETS}, {_windows('tw', 'SELECT tgt AS id, dna AS seq FROM targets')}", "SELECT id AS tgt, count(*)::bigint AS n_windows, sum(length(s))::bigint AS letters, max(win) AS last_win, arg_max(s, win) AS last_window FROM tw GROUP BY 1"),
        "kmer_canonical": f"SELECT item_id, least(km, translate(reverse(km), 'ACGT', 'TGCA')) AS canon, count(*)::bigint AS n, min(km) AS lowest, max(translate(reverse(km), 'ACGT', 'TGCA')) AS highest_rc FROM (SELECT item_id, substr(s, i::int, 8) AS km FROM (SELECT item_id, s, unnest(range(1, length(s)-6)) AS i FROM (SELECT item_id, {n_text} AS s FROM benchmark))) WHERE strpos(km, 'N') = 0 GROUP BY 1, 2",
        "kmer_hash": _with(f"{_READS}, km AS (SELECT DISTINCT query_id, least(k, translate(reverse(k), 'ACGT', 'TGCA')) AS kmer FROM (SELECT query_id, substr(seq1, i::int, 10) AS k FROM (SELECT *, unnest(range(1, length(seq1)-8)) AS i FROM reads))), c AS (SELECT *, {_code('kmer', 10)} AS code FROM km), m1 AS (SELECT *, (xor(code, code >> 16) * 2246822507::hugeint % 4294967296)::bigint AS y1 FROM c), m2 AS (SELECT *, (xor(y1, y1 >> 13) * 3266489909::hugeint % 4294967296)::bigint AS y3 FROM m1)", f"SELECT query_id, kmer, code, {_hash('code')} AS hash, {murmur} AS murmur FROM m2"),
        "sketch_features": _with(_index(), "SELECT tgt, win, feature FROM idx"),
        "wide_sketch_features": _with(f"{_TARGETS}, {_windows('tw', 'SELECT tgt AS id, dna AS seq FROM targets', 21)}, {_wide_sketch('tw', 21)}", "SELECT id AS tgt, win, feature FROM ws"),
        "syncmer_features": _with(f"{_TARGETS}, {_windows('tw', 'SELECT tgt AS id, dna AS seq FROM targets')}, {_syncmers('tw')}", "SELECT id AS tgt, win, feature FROM sy"),
        "kmer_letter_stats": _with(_TARGETS, "SELECT tgt, length(dna)::bigint AS n, " + ", ".join(f"(length(dna) - length(replace(dna, '{x}', '')))::bigint AS n_{x.lower()}" for x in "ACGT") + ", greatest(length(dna)-9, 0)::bigint AS n_kmers FROM targets"),
        "kmer_pair_stats": _with(f"{_TARGETS}, two AS (SELECT tgt, substr(dna, i::int, 2) AS pair FROM (SELECT tgt, dna, unnest(range(1, length(dna))) AS i FROM targets)), names AS (SELECT a || b AS pair FROM (SELECT unnest(['A','C','G','T']) AS a), (SELECT unnest(['A','C','G','T']) AS b))", "SELECT t.tgt, n.pair, coalesce(c.n, 0)::bigint AS n FROM targets t CROSS JOIN names n LEFT JOIN (SELECT tgt, pair, count(*) AS n FROM two GROUP BY 1, 2) c ON c.tgt = t.tgt AND c.pair = n.pair"),
        "kmer_intersection": _with(f"{_READS}, km AS (SELECT query_id AS id, least(k, translate(reverse(k), 'ACGT', 'TGCA')) AS kmer FROM (SELECT query_id, substr(seq1, i::int, 8) AS k FROM (SELECT *, unnest(range(1, length(seq1)-6)) AS i FROM reads)))", "SELECT a.id AS key_a, b.id AS key_b, count(*)::bigint AS shared FROM (SELECT DISTINCT id, kmer FROM km) a JOIN km b USING (kmer) WHERE a.id <> b.id GROUP BY 1, 2"),
        "index_counts": _with(_index(), "SELECT feature, count(*)::bigint AS n FROM idx GROUP BY 1"),
        "index_stats": _with(f"{_index()}, fc AS (SELECT count(*)::bigint AS n FROM idx GROUP BY feature)", f"SELECT n, total::bigint AS total, largest, mean, stddev, skewness FROM ({_moments('n', 'fc')})"),
        "moments": _moments("l_quantity", "lineitem"),
        "moments_removed": _states("l_quantity", "(SELECT * FROM lineitem WHERE l_suppkey % 5 <> 0)"),
        "moments_by_flag": f"SELECT l_returnflag, n, mean, stddev, skewness, kurtosis, excess FROM ({_states('l_extendedprice', 'lineitem', 'l_returnflag')})",
        "layered_statistics": _with(f"{_index(8)}, fc AS (SELECT n FROM (SELECT count(*)::bigint AS n FROM idx GROUP BY feature) WHERE n <= 253)", f"SELECT n, total::bigint AS total, largest, mean, stddev, skewness, kurtosis FROM ({_moments('n', 'fc')})"),
        "index_capped": _with(_index(8), "SELECT feature, tgt, win FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY tgt, win) AS n FROM idx) WHERE n <= 100"),
        "layered_removed": _with(_index(8), "SELECT feature, tgt, win FROM (SELECT *, count(*) OVER (PARTITION BY feature) AS n FROM idx) WHERE n <= 253"),
        "layered_compacted": _with(_index(8), "SELECT feature, tgt, win FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY tgt, win) AS n FROM idx) WHERE n <= 100"),
        "layered_lookup": _with(_hits(), "SELECT query_id, tgt, win, hits FROM hits"),
        "stream_abundance": _with(_classified(**_C4), "SELECT taxid, count(*)::bigint AS n, round(100.0::double * count(*) / (SELECT count(*) FROM cls), 6) AS percent FROM cls GROUP BY 1"),
        "overpopulated_removed": _with(_index(8), "SELECT feature, tgt, win FROM (SELECT *, count(*) OVER (PARTITION BY feature) AS n FROM idx) WHERE n <= 253"),
        "ambiguous_removed": _with(f"{_index()}, owned AS MATERIALIZED (SELECT feature, tgt, win, lang FROM idx JOIN targets USING (tgt)), few AS (SELECT feature FROM (SELECT DISTINCT feature, {_LANG_ID} AS anc FROM owned) GROUP BY 1 HAVING count(*) <= 1)", "SELECT feature, tgt, win FROM owned JOIN few USING (feature)"),
        "dedup_targets": _with(_TARGETS, "SELECT min(tgt) AS tgt, lang || '/' || source AS name FROM targets WHERE length(dna) > 0 GROUP BY lang, source"),
        "feature_probe": _with(f"{_index()}, {_CAPPED}, {_features(_READS)}", "SELECT query_id, feature, tgt, win, n FROM qf JOIN capped USING (feature)"),
        "hits_per_window": _with(_hits(), "SELECT query_id, tgt, win, hits FROM hits"),
        "all_window_ranges": _with(f"{_hits()}, {_ranges()}", 'SELECT query_id, tgt, beg, "end", hits FROM ranges'),
        "best_window_range": _with(f"{_hits()}, {_ranges()}, {_BEST}", 'SELECT query_id, tgt, beg, "end", hits FROM best'),
        "topk_candidates": _with(f"{_hits()}, {_ranges()}, {_BEST}", 'SELECT * FROM (SELECT query_id, tgt, beg, "end", hits, (row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, tgt))::int AS pos FROM best) WHERE pos <= 4'),
        "topk_by_ancestor": _with(f"{_hits()}, {_ranges()}, {_BEST}, {_TAXA}, {_LIN}, {_cands(4, 4)}", 'SELECT query_id, pos, taxid, tgt, hits, beg, "end" FROM cand'),
        "classify_best_target": _with(f"{_hits()}, {_ranges()}, {_BEST}", 'SELECT query_id, tgt, hits, beg, "end" FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, tgt) AS n FROM best) WHERE n = 1 AND hits >= 5'),
        "classify_lca": _with(_classified(), "SELECT query_id, taxid, rank FROM cls"),
        "classify_species": _with(_classified(**_C4), "SELECT query_id, taxid, rank FROM cls"),
        "hits_per_target": _with(_hits(), "SELECT tgt, query_id, string_agg(win || ':' || hits, '/' ORDER BY win) AS list FROM hits GROUP BY 1, 2"),
        "paired_reads": _with(f"{_hits(_PAIRS)}, {_ranges(500)}, {_BEST}", 'SELECT query_id, pos, tgt, hits, beg, "end", span FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, tgt))::int AS pos FROM best) JOIN spans USING (query_id) WHERE pos <= 2'),
        "merge_results": _with(
            f"""{_hits()}, {_ranges()}, {_BEST}, {_TAXA}, {_LIN}, {_cands(4, 6)}, m_ AS (SELECT query_id, taxid, hits, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, tgt % 2, pos, taxid) AS pos FROM cand), m AS (SELECT * FROM m_ WHERE pos <= 3), {_classify(5, 1.0, cand='m')}""",
            "SELECT m.query_id, any_value(c.taxid) AS taxid, any_value(c.rank) AS rank, count(*)::bigint AS n_candidates, max(hits) AS most FROM m LEFT JOIN cls_ c USING (query_id) GROUP BY 1",
        ),
        "tax_lineage_full": _with(f"{_GEO}, {_LIN}", "SELECT taxid, anc, depth, rank FROM lin"),
        "tax_lineage_ranked": _with(f"{_GEO}, {_LIN}", "SELECT taxid, rank, anc FROM ranked"),
        "tax_next_ranked": _with(f"{_GEO}, {_LIN}", "SELECT t.taxid, CASE WHEN t.rank > 0 AND t.rank < 21 THEN t.taxid ELSE u.up END AS anc FROM taxa t LEFT JOIN (SELECT taxid, arg_min(anc, rank) AS up FROM ranked WHERE rank > 0 GROUP BY 1) u USING (taxid)"),
        "tax_lca_full": _with(f"{_GEO}, {_LIN}, {geo_pairs}", "SELECT a, b, arg_min(x.anc, x.depth) AS lca FROM pairs JOIN lin x ON x.taxid = a JOIN lin y ON y.taxid = b AND y.anc = x.anc GROUP BY 1, 2"),
        "tax_lca_intervals": _with(f"{_GEO}, {_LIN}, {geo_pairs}", "SELECT a, b, arg_min(x.anc, x.depth) AS lca FROM pairs JOIN lin x ON x.taxid = a JOIN lin y ON y.taxid = b AND y.anc = x.anc GROUP BY 1, 2"),
        "taxon_coverage_intervals": _with(f"{_TAXA}, {_LIN}", "SELECT anc AS taxid, count(*)::bigint AS n FROM lin WHERE taxid < 0 GROUP BY 1"),
        "tax_intervals": _with(f"{_GEO}, {_LIN}, paths AS (SELECT taxid, list(anc ORDER BY depth DESC) AS path FROM lin GROUP BY 1), below AS (SELECT anc AS taxid, count(*) AS n FROM lin GROUP BY 1), numbered AS (SELECT taxid, (len(path) - 1)::int AS depth, row_number() OVER (ORDER BY path) - 1 AS enter FROM paths)", "SELECT taxid, depth, enter, enter + n - 1 AS leave FROM numbered JOIN below USING (taxid)"),
        "tax_lca_ranked": _with(f"{_GEO}, {_LIN}, {geo_pairs}", "SELECT a, b, arg_min(x.anc, x.rank) AS lca, min(x.rank) AS rank FROM pairs JOIN ranked x ON x.taxid = a JOIN ranked y ON y.taxid = b AND y.anc = x.anc AND y.rank = x.rank GROUP BY 1, 2"),
        "classify_odd_candidates": _with(
            f"""{_GEO}, {_LIN}, c_ AS (SELECT o_orderkey AS query_id, CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey + 50000000 ELSE o_custkey + 2000000 END AS taxid, CASE WHEN o_orderkey % 13 = 0 THEN 3 ELSE 10 END AS hits FROM orders
 UNION ALL SELECT l_orderkey, l_suppkey + 1000000, max(l_quantity % 11)::bigint FROM lineitem WHERE l_orderkey % 3 > 0 GROUP BY 1, 2),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, taxid DESC) AS pos FROM c_), {_classify(4, 0.8, cand='c')}""",
            "SELECT query_id, any_value(x.taxid) AS taxid, any_value(x.rank) AS rank FROM c LEFT JOIN cls_ x USING (query_id) GROUP BY 1",
        ),
        "rank_distribution": _with(_TAXA, "SELECT parent AS taxid, count(*)::bigint AS n FROM taxa WHERE taxid < 0 GROUP BY 1"),
        "taxon_coverage": _with(f"{_TAXA}, {_LIN}", "SELECT anc AS taxid, count(*)::bigint AS n FROM lin WHERE taxid < 0 GROUP BY 1"),
        "abundance": _with(_classified(**_C4), "SELECT taxid, count(*)::bigint AS n, round(100.0::double * count(*) / (SELECT count(*) FROM cls), 6) AS percent FROM cls GROUP BY 1"),
        "abundance_estimate": _with(
            f"""{_GEO}, {_LIN}, cnt AS (SELECT CASE o_orderkey % 6 WHEN 0 THEN n_regionkey+10 WHEN 1 THEN n_nationkey+100 ELSE c_custkey+2000000 END AS taxid, count(*)::double AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
own AS (SELECT taxid, rank AS own FROM taxa),
pairs AS (SELECT c.taxid, r.anc, r.rank FROM cnt c JOIN own USING (taxid) JOIN ranked r USING (taxid) JOIN cnt p ON p.taxid = r.anc WHERE r.rank > own.own),
par AS (SELECT taxid, arg_min(anc, rank) AS p FROM pairs GROUP BY 1), wt AS (SELECT anc AS taxid, sum(n) AS w FROM pairs JOIN cnt USING (taxid) GROUP BY 1),
node AS (SELECT c.taxid, c.n, coalesce(w, 0) AS w, p FROM cnt c LEFT JOIN wt USING (taxid) LEFT JOIN par USING (taxid)),
down(taxid, x, w) AS (SELECT taxid, n, w FROM node WHERE p IS NULL UNION ALL SELECT c.taxid, c.n + d.x * (c.n + c.w) / d.w, c.w FROM down d JOIN node c ON c.p = d.taxid)""",
            "SELECT taxid, round(x, 6) AS n FROM down WHERE w = 0",
        ),
        "clade_exclusion": _with(f"{_hits()}, {_TAXA}, {_LIN}, {_TRUTH}", "SELECT h.* FROM hits h LEFT JOIN truth t USING (query_id) LEFT JOIN ranked a ON a.taxid = t.truth_taxid AND a.rank = 19 LEFT JOIN ranked b ON b.taxid = -h.tgt-1 AND b.rank = 19 WHERE a.anc IS NULL OR b.anc IS DISTINCT FROM a.anc"),
        "extract_accession": _with(f"{_HEADERS}, x AS (SELECT doc_id, header, {_accver('header')} AS accver, {_acc('header')} AS acc, {_GI} AS gi FROM headers)", "SELECT doc_id, accver, acc, gi, coalesce(nullif(accver, ''), nullif(acc, ''), nullif(gi, ''), header) AS seq_id FROM x"),
        "extract_taxid": _with(_HEADERS, f"SELECT doc_id, {_TAXID} AS taxid, split_part(header, ' ', 1) AS word FROM headers"),
        "annotate_headers": _with(
            f"""{_HEADERS}, h AS (SELECT doc_id, header, {_accver('header')} AS acc FROM headers), m AS (SELECT acc, min(doc_id) AS t FROM h WHERE acc <> '' AND doc_id % 2 = 0 GROUP BY 1),
a AS (SELECT doc_id, header, CASE WHEN acc <> '' THEN coalesce(t, 0) END AS t, strpos(header, 'taxid') AS j FROM h LEFT JOIN m USING (acc)),
b AS (SELECT *, CASE WHEN j > 0 THEN {_find('header', '|', '(j + 4)')} ELSE 0 END AS k FROM a),
c AS (SELECT *, CASE WHEN {_find('header', ' ', '(k + 1)')} > 0 THEN {_find('header', ' ', '(k + 1)')} WHEN {_find('header', '|', '(k + 1)')} > 0 THEN {_find('header', '|', '(k + 1)')} ELSE length(header) END AS l FROM b),
e AS (SELECT doc_id, t, CASE WHEN k > 0 THEN substr(header, 1, j-1) || substr(header, l+1) ELSE header END AS bare FROM c)""",
            "SELECT doc_id, CASE WHEN t IS NULL THEN bare WHEN strpos(bare, ' ') > 0 THEN substr(bare, 1, strpos(bare, ' ')) || 'taxid|' || t || ' ' || substr(bare, strpos(bare, ' ') + 1) ELSE bare || ' ' || 'taxid|' || t || ' ' END AS line FROM e",
        ),
        "similar_name_lookup": "WITH p AS (SELECT DISTINCT p_name FROM part), w AS (SELECT DISTINCT substr(p_name, 1, greatest(length(p_name)-4, 1)) AS acc FROM p WHERE p_name <> '') SELECT acc, min(p_name) AS similar FROM w LEFT JOIN p ON starts_with(p_name, acc) AND p_name > acc GROUP BY 1",
        "parent_resolution": """WITH m AS (SELECT 'acc' || c_custkey || '.1' AS key, c_nationkey::bigint AS taxid FROM customer WHERE c_custkey % 3 = 0),
t AS (SELECT s_suppkey AS tgt, 'acc' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '.1' ELSE '' END AS seq_id, 'acc' || (s_suppkey+1) || '.1' AS file_id, s_suppkey % 4 - 1 AS ht FROM supplier),
f AS (SELECT acc, coalesce((SELECT taxid FROM m WHERE key = acc), (SELECT arg_min(taxid, key) FROM m WHERE starts_with(key, acc) AND key > acc)) AS taxid FROM (SELECT seq_id AS acc FROM t UNION SELECT file_id FROM t))
SELECT tgt, coalesce(CASE WHEN a.taxid > 0 THEN a.taxid END, CASE WHEN b.taxid > 0 THEN b.taxid END, CASE WHEN ht > 0 THEN ht END, 0)::bigint AS parent FROM t LEFT JOIN f a ON a.acc = seq_id LEFT JOIN f b ON b.acc = file_id""",
        "post_rank_mapping": """WITH t AS (SELECT p_partkey AS tgt, CASE p_partkey % 3 WHEN 0 THEN 'p' || p_partkey WHEN 1 THEN 'p' || p_partkey || '.1' ELSE p_partkey::varchar END AS name, CASE WHEN p_partkey % 10 = 0 THEN p_partkey ELSE 0 END AS parent FROM part),
r AS (SELECT l_orderkey % 2 AS file, l_orderkey*8 + l_linenumber AS row_, 'p' || l_partkey || '.' AS acc, 'p' || l_partkey AS accver, l_partkey::varchar AS gi, l_suppkey AS taxid FROM lineitem),
near AS (SELECT acc, min(name) AS name FROM (SELECT DISTINCT acc FROM r) JOIN t ON starts_with(name, acc) AND name > acc GROUP BY 1),
f AS (SELECT r.*, coalesce(a.tgt, b.tgt, c.tgt) AS tgt FROM r LEFT JOIN t a ON a.name = r.accver LEFT JOIN near n ON n.acc = r.acc LEFT JOIN t b ON b.name = n.name LEFT JOIN t c ON c.name = r.gi)
SELECT tgt, arg_min(taxid, file * 1000000000 + row_) AS parent FROM f JOIN t USING (tgt) WHERE parent = 0 GROUP BY 1""",
        "ground_truth": _with(
            f"""{_TAXA}, {_LIN}, named AS (SELECT taxid, rank, CASE WHEN taxid < 0 THEN 'NC_' || lpad((-taxid-1)::varchar, 6, '0') || '.1' ELSE name END AS name FROM taxa),
h AS (SELECT item_id+1 AS query_id, 'NC_' || lpad(item_id::varchar, 6, '0') AS a, CASE item_id % 6 WHEN 0 THEN a || '.1 whole' WHEN 1 THEN a || '.7 other version' WHEN 2 THEN 'contig taxid|108000 end' WHEN 3 THEN 'fr' WHEN 4 THEN 'nothing known' ELSE 'gi|5|ref|' || a || '.1| named' END AS header FROM benchmark),
x AS (SELECT query_id, header, {_accver('header')} AS accver, {_acc('header')} AS acc, {_TAXID} AS id FROM h),
near AS (SELECT acc, min(name) AS name FROM (SELECT DISTINCT acc FROM x WHERE acc <> '') JOIN named ON starts_with(name, acc) AND name > acc GROUP BY 1),
by_name AS (SELECT name, min(taxid) AS t FROM named GROUP BY 1),
r AS (SELECT query_id, coalesce(a.t, b.t, c.taxid, d.t) AS t FROM x LEFT JOIN by_name a ON a.name = accver LEFT JOIN near USING (acc) LEFT JOIN by_name b ON b.name = near.name LEFT JOIN taxa c ON c.taxid = id LEFT JOIN by_name d ON d.name = header)""",
            "SELECT query_id, CASE WHEN x.rank > 0 AND x.rank < 21 THEN x.taxid ELSE u.up END AS truth_taxid FROM r LEFT JOIN taxa x ON x.taxid = r.t LEFT JOIN (SELECT taxid, arg_min(anc, rank) AS up FROM ranked WHERE rank > 0 GROUP BY 1) u ON u.taxid = x.taxid",
        ),
        "classification_stats": _with(f"{_classified()}, {_TRUTH}, {_STATS}, tot AS (SELECT sum(assigned) FILTER (rank >= 20) AS total FROM st)", f"SELECT rank, assigned, known, correct, wrong, {share('assigned', 'total', 'classified_rate')}, {share('known', 'total', 'known_rate')}, {share('correct', 'correct+wrong', 'precision')}, {share('correct', 'known', 'sensitivity')} FROM st, tot"),
        "coverage_confusion": _with(
            f"""{_classified()}, {_TRUTH}, cov AS (SELECT anc AS taxid FROM lin WHERE taxid < 0 GROUP BY 1 HAVING count(*) > 20 OR anc % 2 = 0),
x AS (SELECT r.rank, r.anc IN (SELECT taxid FROM cov) AS cov, c.rank IS NOT NULL AND r.rank >= c.rank AS on_ FROM cls c JOIN truth t USING (query_id) JOIN ranked r ON r.taxid = t.truth_taxid),
y AS (SELECT rank, count(*) FILTER (cov AND on_)::bigint AS tp, count(*) FILTER (NOT cov AND on_)::bigint AS fp, count(*) FILTER (NOT cov AND NOT on_)::bigint AS tn, count(*) FILTER (cov AND NOT on_)::bigint AS fn FROM x GROUP BY 1)""",
            f"SELECT rank, tp, fp, tn, fn, {share('tp+tn', 'tp+fp+tn+fn', 'accuracy')}, {share('tp', 'tp+fn', 'sensitivity')}, {share('tn', 'tn+fp', 'specificity')}, {share('tp', 'tp+fp', 'precision')}, {share('tn', 'tn+fn', 'negative_value')}, {share('fn', 'tn+fn', 'false_omission')}, {share('fp', 'tn+fp', 'fall_out')}, {share('fp', 'tp+fp', 'false_discovery')}, {share('fn', 'tp+fn', 'miss_rate')} FROM y",
        ),
        "mapping_report": _with(
            f"{_classified(**_C4)}, th AS (SELECT query_id, string_agg(taxid || ':' || hits, ',' ORDER BY pos) AS top_hits FROM cand GROUP BY 1)",
            "SELECT query_id, query_id || chr(9) || '|' || chr(9) || split_part(header, ' ', 1) || chr(9) || '|' || chr(9) || coalesce(top_hits, '') || chr(9) || '|' || chr(9) || CASE WHEN c.taxid IS NULL THEN '--' ELSE CASE c.rank " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(RANKS)) + " END || ':' || t.name || '(' || c.taxid || ')' END AS line FROM cls c JOIN reads USING (query_id) LEFT JOIN th USING (query_id) LEFT JOIN taxa t ON t.taxid = c.taxid",
        ),
        "all_hits_report": _with(_hits(), "SELECT query_id, string_agg('doc_' || tgt || '/' || win || ':' || hits, ',' ORDER BY tgt, win) AS all_hits FROM hits GROUP BY 1"),
        "locations_report": _with(f"{_hits()}, {_ranges()}, {_BEST}, {_TAXA}, {_LIN}, {_cands(4, 4)}", "SELECT query_id, string_agg('[' || beg*119 || ',' || (\"end\"*119+128) || ']', ' ' ORDER BY pos) AS locations FROM cand GROUP BY 1"),
        "abundance_report": _with(
            f"{_classified(**_C4)}, ab AS (SELECT taxid, count(*) AS n, round(100.0::double * count(*) / (SELECT count(*) FROM cls), 6) AS percent FROM cls GROUP BY 1)",
            "SELECT a.taxid, CASE WHEN a.taxid IS NULL THEN 'unclassified' ELSE CASE t.rank " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(RANKS)) + " END || ':' || t.name END || chr(9) || '|' || chr(9) || a.n || chr(9) || '|' || chr(9) || a.percent || '%' AS line, (row_number() OVER (ORDER BY t.rank DESC NULLS LAST, a.taxid))::int AS pos FROM ab a LEFT JOIN taxa t ON t.taxid = a.taxid",
        ),
        "info_targets": _with(f"{_TARGETS}, {_TAXA}, {_LIN}", "SELECT tgt, name, (CASE WHEN length(dna) <= 128 THEN 1 ELSE (length(dna)-128)//119 + 1 + CASE WHEN ((length(dna)-128)//119 + 1)*119 < length(dna) THEN 1 ELSE 0 END END)::bigint AS windows, s.anc AS species, o.anc AS domain FROM targets t LEFT JOIN ranked s ON s.taxid = t.taxid AND s.rank = 4 LEFT JOIN ranked o ON o.taxid = t.taxid AND o.rank = 19"),
        "info_lineages": _with(f"{_TAXA}, {_LIN}", "SELECT taxid, " + ", ".join(f'coalesce(max(anc) FILTER (rank = {i}), 0) AS "{RANKS[i]}"' for i in range(20)) + " FROM ranked WHERE taxid < 0 GROUP BY 1"),
        **_file_sql(),
        "integer_hashes": _hash_sql(),
        "align_scores": _with(_ALIGNED, "SELECT query_id, any_value(tgt) AS tgt, max(s)::int AS score FROM dp JOIN strands USING (query_id, rc) JOIN pairs USING (query_id) WHERE i = length(q) OR j = length(strands.part) GROUP BY 1"),
        "semi_global_align": _with(
            f"""{_ALIGNED}, ends AS (SELECT query_id, rc, i, j, s, i < length(q) AS side, q, part FROM dp JOIN strands USING (query_id, rc) WHERE i = length(q) OR j = length(part)),
won AS MATERIALIZED (SELECT query_id, rc, i AS ei, j AS ej, s, q, part FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, rc DESC, side, i, j) AS n FROM ends) WHERE n = 1),
own AS (SELECT d.query_id, d.i, d.j, d.s, substr(w.q, d.i, 1) = substr(w.part, d.j, 1) AS same, lag(d.s) OVER line AS l FROM dp d JOIN won w USING (query_id, rc) WINDOW line AS (PARTITION BY d.query_id, d.i ORDER BY d.j)),
ways AS MATERIALIZED (SELECT a.query_id, a.i, string_agg(CASE WHEN a.s = u.l + CASE WHEN a.same THEN 2 ELSE -1 END THEN 'D' WHEN a.s = u.s - 1 THEN 'U' ELSE 'L' END, '' ORDER BY a.j) AS way
 FROM own a JOIN own u ON u.query_id = a.query_id AND u.i = a.i-1 AND u.j = a.j WHERE a.i > 0 AND a.j > 0 GROUP BY 1, 2),
path(query_id, i, j, top, bottom) AS (SELECT query_id, ei, ej, substr(q, ei+1) || repeat('_', length(part)-ej), repeat('_', length(q)-ei) || substr(part, ej+1) FROM won
 UNION ALL SELECT query_id, i - (m <> 'L')::int, j - (m <> 'U')::int, CASE WHEN m = 'L' THEN '_' ELSE substr(q, i, 1) END || top, CASE WHEN m = 'U' THEN '_' ELSE substr(part, j, 1) END || bottom
  FROM (SELECT p.*, w.q, w.part, substr(x.way, p.j, 1) AS m FROM path p JOIN won w USING (query_id) JOIN ways x ON x.query_id = p.query_id AND x.i = p.i WHERE p.i > 0 AND p.j > 0))""",
            "SELECT query_id, tgt, s::int AS score, repeat('_', p.j) || substr(w.q, 1, p.i) || top AS query, substr(w.part, 1, p.j) || repeat('_', p.i) || bottom AS subject FROM path p JOIN won w USING (query_id) JOIN pairs USING (query_id) WHERE p.i = 0 OR p.j = 0",
        ),
        "stream_classify": _with(_classified(), "SELECT query_id, taxid, rank FROM cls"),
    }
