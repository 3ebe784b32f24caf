"""DuckDB SQL of the operators that SQL can express on whole tables."""

from __future__ import annotations

from . import merkle, mixing, quality
from .common import WORD


def mix_sql() -> str:
    """The same mix, slot by slot: ranks by one window, blocks by one join of documents' stretches with slots."""
    weights = " ".join(f"WHEN r % {len(mixing.WEIGHTS)} = {i} THEN {w}" for i, w in enumerate(mixing.WEIGHTS))
    slots = mixing.SLOTS
    return f"""
WITH d AS (SELECT doc_id, source, md5(coalesce(cast(doc_id AS varchar), '') || '|' || coalesce(md5(source), '') || '|' || coalesce(text, '')) AS row_key, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS size, md5(coalesce(cast(doc_id AS varchar), '')) AS k FROM documents),
p AS (SELECT *, row_number() OVER w AS nth, cast(sum(size) OVER w - size AS bigint) AS start FROM d
  WINDOW w AS (PARTITION BY source ORDER BY cast('0x' || left(k, 3) AS int) % {mixing.BUCKETS}, k, doc_id, size, row_key ROWS UNBOUNDED PRECEDING)),
s AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
w AS (SELECT *, cast(CASE {weights} END AS double) AS weight, source_size * {mixing.MOST_REPEATS}.0::double AS cap FROM s),
o AS (SELECT *, cap / weight AS ratio, cast(sum(source_size) OVER () AS double) AS words,
  coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
  sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS free FROM w),
l AS (SELECT arg_min((words - capped) / free, ratio) AS level FROM o WHERE (words - capped) / free <= ratio),
t AS (SELECT source, cast(source_size AS bigint) AS source_size, words, least(cap, level * weight) AS target FROM o, l),
h AS (SELECT *, sum(target / words) OVER (ORDER BY source NULLS LAST) AS hi, row_number() OVER (ORDER BY source DESC NULLS FIRST) = 1 AS final,
  cast(greatest(ceil(words / {slots}), 1) AS bigint) AS b, cast(round(target) AS bigint) AS wanted FROM t WHERE source_size > 0),
n AS (SELECT *, hi - target / words AS lo, wanted // source_size AS whole, wanted % source_size AS rest FROM h),
f AS (SELECT source, source_size, target, lo, CASE WHEN final THEN 2.0 ELSE hi END AS hi, b, cast(ceil(source_size / b) AS bigint) AS blocks, whole, rest,
  whole * cast(ceil(source_size / b) AS bigint) + cast(ceil(rest / b) AS bigint) AS ranks FROM n),
g AS (SELECT i AS slot, f.*, row_number() OVER (PARTITION BY source ORDER BY i) - 1 AS rank FROM (SELECT i, (i * {mixing.GOLDEN} % {1 << 32}) / {float(1 << 32)} AS x FROM range({slots}) r(i)) JOIN f ON x >= lo AND x < hi),
e AS (SELECT {slots} + rank AS slot, source, rank FROM (SELECT f.source, unnest(range(coalesce(had, 0), ranks)) AS rank FROM f LEFT JOIN (SELECT source, count(*) AS had FROM g GROUP BY source) c ON f.source IS NOT DISTINCT FROM c.source)),
a AS (SELECT slot, source, rank FROM g UNION ALL SELECT slot, source, rank FROM e),
c AS (SELECT slot, a.source, rank % blocks AS block, b, CASE WHEN rank >= whole * blocks THEN least(least(b, source_size - rank % blocks * b), rest - rank % blocks * b) ELSE least(b, source_size - rank % blocks * b) END AS take
  FROM a JOIN f ON a.source IS NOT DISTINCT FROM f.source WHERE rank < ranks),
q AS (SELECT p.source, nth, start, size, unnest(range(start // b, (start + size - 1) // b + 1)) AS block FROM p JOIN f ON p.source IS NOT DISTINCT FROM f.source WHERE size > 0),
m AS (SELECT q.source, nth, slot, least(start + size, block * b + take) - greatest(start, block * b) AS n_words FROM q JOIN c USING (block) WHERE q.source IS NOT DISTINCT FROM c.source),
u AS (SELECT source, nth, sum(n_words) AS taken, min(slot) AS first_slot, count(DISTINCT slot) AS n_slots FROM m WHERE n_words > 0 GROUP BY source, nth)
SELECT doc_id, cast(size AS bigint) AS size, source_size, target, cast(coalesce(taken, 0) AS bigint) AS taken, cast(first_slot AS bigint) AS first_slot, cast(coalesce(n_slots, 0) AS bigint) AS n_slots
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source LEFT JOIN u ON p.source IS NOT DISTINCT FROM u.source AND p.nth = u.nth"""


def quality_sql() -> str:
    bins, classes = quality.BINS, quality.CLASSES
    names = [f"c{i}" for i in range(classes)], [f"b{i}" for i in range(bins + 1)]

    def distance(columns: list[str]) -> str:
        own, ref = " + ".join(columns), " + ".join(f"r{c}" for c in columns)
        p, q = "({0} / cast(na AS double))", "(r{0} / cast(nb AS double))"
        m = f"(({p} + {q}) / 2)"
        term = f"CASE WHEN {{0}} > 0 THEN {p} * log2({p} / {m}) ELSE 0 END + CASE WHEN r{{0}} > 0 THEN {q} * log2({q} / {m}) ELSE 0 END"
        terms = " + ".join(f"({term})".replace("{0}", c) for c in columns).replace("na", f"({own})").replace("nb", f"({ref})")
        return f"CASE WHEN {own} > 0 AND {ref} > 0 THEN sqrt(greatest(0, ({terms}) / 2)) END"

    sums = ", ".join(f"sum({c}) AS r{c}" for c in [*names[0], *names[1]])
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS lower_words, regexp_replace(coalesce(text, ''), '[a-z\\x20\\x09-\\x0D]+', '', 'g') AS rest FROM documents),
w AS (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS nth FROM (SELECT lang, unnest(lower_words) AS word FROM d) WHERE regexp_full_match(word, '{quality.LETTERS}') GROUP BY lang, word),
t AS (SELECT lang AS of_lang, list(word ORDER BY nth) AS common FROM w WHERE nth <= {bins} GROUP BY lang),
v AS (SELECT id, unnest(range(1, len(words) - {quality.WINDOW - 2})) AS i, words FROM d WHERE len(words) >= {quality.WINDOW}),
g AS (SELECT id, i, count(*) OVER (PARTITION BY id, array_to_string(words[i:i + {quality.WINDOW - 1}], ' ')) AS n FROM v),
r AS (SELECT id, count(DISTINCT k) AS n_repeat_words FROM (SELECT id, unnest(range(i, i + {quality.WINDOW})) AS k FROM g WHERE n > 1) GROUP BY id),
m AS (SELECT doc_id, lang, len(words) AS n_words, coalesce(length(array_to_string(words, '')), 0) AS word_chars, len(regexp_extract_all(rest, '{quality.SYMBOLS}')) AS n_symbols,
  len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')))) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, length(text) AS chars, length(rest) AS n_rest, len(regexp_extract_all(rest, '[A-Z]')) AS upper_, len(regexp_extract_all(rest, '[0-9]')) AS digit_, len(regexp_extract_all(rest, '[\\x00-\\x7F]')) AS ascii_,
  {", ".join(f"len(list_filter(lower_words, lambda x: x = common[{i + 1}])) AS b{i}" for i in range(bins))} FROM d LEFT JOIN r USING (id) LEFT JOIN t ON lang IS NOT DISTINCT FROM of_lang),
h AS (SELECT *, word_chars - n_rest AS c0, upper_ AS c1, digit_ AS c2, chars - word_chars AS c3, n_symbols AS c4, ascii_ - upper_ - digit_ - n_symbols AS c5, n_rest - ascii_ AS c6, n_words - ({" + ".join(f"b{i}" for i in range(bins))}) AS b{bins} FROM m),
e AS (SELECT lang, sum(n_words) AS r_words, {sums} FROM h GROUP BY lang),
x AS (SELECT h.*, e.* EXCLUDE (lang) FROM h JOIN e ON h.lang IS NOT DISTINCT FROM e.lang),
y AS (SELECT *, CASE WHEN r_words >= {quality.MIN_REFERENCE_WORDS} AND chars >= {quality.MIN_CHARS} THEN {distance(names[0])} END AS class_distance,
  CASE WHEN r_words >= {quality.MIN_REFERENCE_WORDS} AND n_words >= {quality.MIN_WORDS} THEN {distance(names[1])} END AS word_distance, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM x)
SELECT doc_id, cast(n_words AS bigint) AS n_words, cast(word_chars AS bigint) AS word_chars, cast(n_symbols AS bigint) AS n_symbols, cast(n_dup_lines AS bigint) AS n_dup_lines, cast(n_repeat_words AS bigint) AS n_repeat_words, base_failed,
  NOT base_failed AND coalesce(class_distance, 0) <= {quality.MAX_CLASS_DISTANCE} AND coalesce(word_distance, 0) <= {quality.MAX_WORD_DISTANCE} AS kept, class_distance, word_distance FROM y"""


def merkle_sql() -> str:
    """The same trees, level by level in a recursion over all of them; DuckDB has no CRC-32, so its bits are reduced here."""
    said = lambda c: f"coalesce(strlen({c}) || ':' || {c}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(said(c) for c in ("cast(doc_id AS varchar)", "source", "lang", "cast(n_chars AS varchar)", text)) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    step = "list_reduce(list_prepend(xor(c, b), [cast(i AS ubigint) FOR i IN range(8)]), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::ubigint) ELSE x >> 1 END)"
    codes = "[cast(ord(d) AS ubigint) FOR d IN string_split(coalesce(cast(doc_id AS varchar), ''), '') IF d <> '']"
    crc = f"xor(list_reduce(list_prepend(4294967295::ubigint, {codes}), lambda c, b: {step}), 4294967295::ubigint)"

    def tree(name: str, nodes: str) -> str:
        """name(t, level, pos, hash, n): nodes (t, pos, hash) and all levels above; n: nodes of the level."""
        return f"""{name} AS (SELECT t, 0 AS level, pos, hash, count(*) OVER (PARTITION BY t) AS n FROM {nodes}
  UNION ALL SELECT *, count(*) OVER (PARTITION BY t) AS n FROM (SELECT t, level + 1 AS level, pos // {merkle.ARITY} AS pos, sha256(string_agg(hash, '' ORDER BY pos)) AS hash FROM {name} WHERE n > 1 GROUP BY t, level, pos // {merkle.ARITY}))"""

    def pairs(name: str, nodes: str) -> str:
        """name(t, level, pos, l, r): the hashes to the left and right of a node within its group."""
        w = f"PARTITION BY t, level, pos // {merkle.ARITY} ORDER BY pos ROWS BETWEEN"
        return f"""{name} AS (SELECT t, level, pos, coalesce(string_agg(hash, '') OVER ({w} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(hash, '') OVER ({w} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {nodes} WHERE n > 1)"""

    arity = merkle.ARITY
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, lang AS t, {leaf("text")} AS hash, CASE WHEN {crc} % {merkle.ALTERED} = 0 THEN {leaf(lower)} END AS tampered FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, hash) - 1 AS pos FROM d),
{tree("a", "k")}, {pairs("ap", "a")},
s AS (SELECT t AS lang, '' AS t, hash, row_number() OVER (ORDER BY t NULLS FIRST) - 1 AS pos FROM a WHERE n = 1),
{tree("b", "s")}, {pairs("bp", "b")}, z AS (SELECT hash AS root FROM b WHERE n = 1),
u AS (SELECT s.lang, s.hash AS subroot, bp.level, l, r FROM s LEFT JOIN bp ON bp.pos = s.pos // cast({arity} ** bp.level AS bigint)),
p AS (SELECT k.t, k.pos, 0 AS tier, ap.level, l, r FROM k JOIN ap ON k.t IS NOT DISTINCT FROM ap.t AND ap.pos = k.pos // cast({arity} ** ap.level AS bigint)
  UNION ALL SELECT k.t, k.pos, 1, u.level, l, r FROM k JOIN u ON k.t IS NOT DISTINCT FROM u.lang WHERE u.level IS NOT NULL),
q AS (SELECT t, pos, string_agg(l || r, '' ORDER BY tier, level) AS proof, list({{'l': l, 'r': r}} ORDER BY tier, level) AS steps FROM p GROUP BY t, pos),
f AS (SELECT k.doc_id, k.hash AS leaf, k.t, coalesce(tampered, k.hash) AS h, coalesce(steps, []) AS steps, coalesce(proof, '') AS proof, 1 AS i FROM k LEFT JOIN q ON k.t IS NOT DISTINCT FROM q.t AND k.pos = q.pos
  UNION ALL SELECT doc_id, leaf, t, sha256(steps[i].l || h || steps[i].r), steps, proof, i + 1 FROM f WHERE i <= len(steps))
SELECT doc_id, leaf, s.hash AS subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified
FROM f JOIN s ON f.t IS NOT DISTINCT FROM s.lang, z WHERE i = len(steps) + 1"""


ORACLE_SQL = {"op12_merkle_manifest": merkle_sql(), "op8_quality_rules": quality_sql(), "op9_mix_sources": mix_sql()}
