"""DuckDB SQL for the registered queries, written as chains of common table expressions over the derived tracks."""

from __future__ import annotations

from ..functions import flags as G
from ..functions import text as X
from ..options import ARTIST_SEPARATORS, BLOCKING, DEFAULT, HARD, MANUAL, PENDING, PREFIX_SEPARATORS, SOFT, STOP_WORDS, UPPER_NAMES
from ..sources.tables import DUCK_DECISIONS, DUCK_PREVIOUS, DUCK_RESPONSES, DUCK_TRACKS

O = DEFAULT


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def names(items) -> str:
    return ", ".join(map(q, items))


def sub(s: str, pattern: str, put: str = "") -> str:
    return f"regexp_replace({s}, {q(pattern)}, {q(put)}, 'g')"


def like(s: str, pattern: str) -> str:
    return f"regexp_matches({s}, {q(pattern)})"


def strip(s: str) -> str:
    return sub(s, f"^{X.WS}+|{X.WS}+$")


def lstrip(s: str) -> str:
    return sub(s, f"^{X.WS}+")


def rstrip(s: str) -> str:
    return sub(s, f"{X.WS}+$")


def squeeze(s: str) -> str:
    return strip(sub(s, f"{X.WS}+", " "))


def blank(s: str) -> str:
    return f"(NOT {like(f'coalesce({s}, {q(str())})', f'[^{X.SPACES}]')})"


def symbolic(s: str) -> str:
    t = f"lower({strip(f'coalesce({s}, {q(str())})')})"
    return f"({like(t, '^[a-zß-ÿ]{1,6}$')} AND (replace({t}, left({t}, 1), '') = '' OR {like(t, '^[ivx]+$')}))"


def unreadable(s: str) -> str:
    t = strip(f"coalesce({s}, '')")
    return f"(NOT {symbolic(s)} AND (length({t}) < 2 OR length({sub(t, '[^\\p{L}]')}) / greatest(length({t}), 1) < 0.3))"


def detect(t: str, a: str) -> str:
    t, a = f"coalesce({t}, '')", f"coalesce({a}, '')"
    s = strip(t)
    rules = {
        "artist_missing": blank(a),
        "embedded_track_number": like(t, G.NUMBERED),
        "embedded_artist": f"(contains({t}, ' - ') AND len(string_split({t}, ' - ')) <= 4)",
        "junk_prefix": "(" + " OR ".join(f"starts_with(lower({lstrip(t)}), {q(p)})" for p in O.junk_prefixes) + ")",
        "junk_suffix": "(" + " OR ".join(f"ends_with(lower({rstrip(t)}), {q(p)})" for p in O.junk_suffixes) + ")",
        "original_mix_redundant": like(t, G.ORIGINAL_MIX),
        "bpm_suffix": like(t, G.TEMPO_MARK),
        "weird_separators": f"(contains({t}, '_') OR contains({t}, '  ') OR " + " OR ".join(f"contains({t}, {q(x)})" for x in O.replace_with_dash) + f" OR {like(t, G.DASHES)})",
        "bad_capitalization": f"({like(t, '\\p{L}')} AND NOT {symbolic(t)} AND ({s} = lower({s}) AND {s} <> upper({s}) OR {s} = upper({s}) AND length({s}) > 3))",
        "generic_track_name": like(t, X.GENERIC),
        "unreadable_title": f"({blank(t)} OR {unreadable(t)})",
        "duplicate_artist_title": f"({a} <> '' AND {t} <> '' AND lower({strip(a)}) = lower({s}))",
        "scene_junk": "(" + " OR ".join(f"contains(lower({t}), {q(m)})" for m in O.scene_markers) + ")",
        "missing_artist_but_present_in_title": f"({blank(a)} AND contains({t}, ' - '))",
    }
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {q(n)} END" for n, c in rules.items()) + "], lambda x: x IS NOT NULL)"


def overlap(flags: str, these) -> str:
    return f"list_has_any({flags}, [{names(these)}])"


def track_number(s: str) -> str:
    rest = lstrip(f"regexp_replace({s}, {q(X.NUMBER)}, '')")
    return f"CASE WHEN {like(s, X.NUMBER)} AND length({rest}) >= 2 THEN {rest} ELSE {s} END"


def separators(s: str) -> tuple[str, str]:
    hits = []
    for token, put in [(x, " - ") for x in O.replace_with_dash] + [(x, " ") for x in O.collapse]:
        hits.append(f"contains({s}, {q(token)})")
        s = f"replace({s}, {q(token)}, {q(put)})"
    return squeeze(s), "(" + " OR ".join(hits) + ")"


def after(s: str, n: str) -> str:
    return f"ltrim(substr({s}, {n} + 1), {q(X.EDGE)})"


def tempo(s: str, k: int) -> str:
    rest = f"rtrim(regexp_replace({s}, {q(X.TEMPO[k])}, ''), {q(' -_[(),')})"
    return f"CASE WHEN {like(s, X.TEMPO[k])} AND NOT {blank(rest)} THEN {rest} ELSE {s} END"


def original_mix(s: str) -> str:
    return "CASE " + " ".join(f"WHEN {like(s, p)} THEN {rstrip(f'regexp_replace({s}, {q(p)}, {q(str())})')}" for p in X.MIX) + f" ELSE {s} END"


def artist_prefix(t: str, artists: tuple[str, ...]) -> str:
    cases = []
    for name in (strip(f"coalesce({a}, '')") for a in artists):
        for s in ARTIST_SEPARATORS:
            rest = after(t, f"(length({name}) + {len(s)})")
            cases.append(f"WHEN {name} <> '' AND starts_with(lower({t}), lower({name} || {q(s)})) AND NOT {blank(rest)} THEN {rest}")
    return "CASE " + " ".join(cases) + f" ELSE {t} END"


def junk_prefix(t: str) -> str:
    return "CASE " + " ".join(f"WHEN starts_with(lower({lstrip(t)}), {q(x)}) THEN {after(lstrip(t), str(len(x)))}" for x in O.junk_prefixes) + f" ELSE {t} END"


def junk_suffix(t: str) -> str:
    return "CASE " + " ".join(f"WHEN ends_with(lower({rstrip(t)}), {q(x)}) THEN rtrim(left({rstrip(t)}, length({rstrip(t)}) - {len(x)}), {q(X.EDGE)})" for x in O.junk_suffixes) + f" ELSE {t} END"


def title_case(s: str) -> str:
    word = lambda w: f"(NOT {like(w, f'^(?:{X.WS}+|[-/])$')})"
    toks = f"regexp_extract_all({s}, {q(f'({X.WS}+|[-/]|[^-/{X.SPACES}]+)')}, 1)"
    n = f"len(list_filter({toks}, lambda w: {word('w')}))"
    nth = f"len(list_filter(({toks})[1:i - 1], lambda w: {word('w')}))"
    one = (f"CASE WHEN NOT {word('x')} THEN x WHEN upper(x) IN ({names(UPPER_NAMES)}) THEN upper(x) "
           f"WHEN lower(x) IN ({names(STOP_WORDS)}) AND {nth} > 0 AND {nth} < {n} - 1 THEN lower(x) ELSE upper(left(x, 1)) || lower(substr(x, 2)) END")
    return f"coalesce(array_to_string(list_transform({toks}, lambda x, i: {one}), ''), '')"


def filename(s: str, two: str) -> str:
    """A struct (artist, title) or null."""
    cases = []
    for pattern, both, allowed in [(*p, None) for p in X.FILENAMES] + [(*X.TWO_PARTS, two)]:
        title = strip(f"regexp_extract({s}, {q(pattern)}, {2 if both else 1})")
        artist = strip(f"regexp_extract({s}, {q(pattern)}, 1)") if both else "cast(NULL as varchar)"
        fit = f"{like(s, pattern)} AND length({title}) >= 2" + f" AND length({artist}) >= 2" * both + f" AND {allowed}" * bool(allowed)
        cases.append(f"WHEN {fit} THEN {{'artist': {artist}, 'title': {title}}}")
    return "CASE " + " ".join(cases) + " END"


STEM = squeeze("replace(regexp_replace(filename, '^(.+)\\.[^.]*$', '\\1', 's'), '_', ' ')")
ORDER = "coalesce(disc_number, 0), coalesce(track_number, 0), lower(filename), filename"
SAMPLED = "(pos IN (0, 1) OR pos = (n - 1) // 2 OR pos = n - 1)"


class Chain:
    """Common table expressions, one after another."""

    def __init__(self) -> None:
        self.steps = [f"t AS ({DUCK_TRACKS})", f"p AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY {ORDER}) - 1 AS pos, count(*) OVER (PARTITION BY root) AS n FROM t)"]
        self.last = "p"

    def add(self, name: str, select: str) -> Chain:
        self.steps.append(f"{name} AS MATERIALIZED ({select})")
        self.last = name
        return self

    def then(self, select: str) -> Chain:
        """select has {0} for what was last added."""
        name = f"s{len(self.steps)}"
        return self.add(name, select.replace("{0}", self.last))

    def sql(self, select: str) -> str:
        return "WITH " + ",\n".join(self.steps) + "\n" + select.replace("{0}", self.last)


def chain() -> Chain:
    return Chain()


def hints(c: Chain) -> Chain:
    t, a = strip("coalesce(title, '')"), strip("coalesce(artist, '')")
    left, right = strip(f"split_part({t}, ' - ', 1)"), strip(f"split_part({t}, ' - ', 2)")
    hint = f"(len(string_split({t}, ' - ')) = 2 AND length({left}) >= 2 AND length({right}) >= 2 AND ({a} = '' OR lower({a}) = lower({t})))"
    c.add("h", f"SELECT *, {STEM} AS stem FROM p")
    return c.add("hinted", f"SELECT root, count(*) FILTER ({SAMPLED} AND {hint}) AS split_hints, count(*) FILTER ({filename('stem', 'false')} IS NOT NULL) AS filename_hints FROM h GROUP BY root")


def prefix(c: Chain) -> Chain:
    c.add("pt", f"SELECT root, pos, {strip(track_number('coalesce(title, ' + q('') + ')'))} AS tt FROM p")
    c.add("pn", "SELECT *, count(*) OVER (PARTITION BY root) AS titles FROM pt WHERE tt <> ''")
    cuts = " UNION ALL ".join(f"SELECT root, pos, titles, unnest(list_transform(range(1, len(string_split(tt, {q(s)}))), lambda i: array_to_string(string_split(tt, {q(s)})[1:i], {q(s)}) || {q(s)})) AS prefix FROM pn WHERE titles >= 3 AND contains(tt, {q(s)})" for s in PREFIX_SEPARATORS)
    c.add("pc", f"SELECT * FROM ({cuts}) WHERE length(prefix) >= 4")
    c.add("pg", "SELECT root, lower(prefix) AS low, count(*) AS support, arg_min(prefix, pos) AS prefix, min(pos) AS pos FROM pc GROUP BY root, lower(prefix), titles HAVING count(*) >= greatest(2, floor(titles * cast(0.6 as double)))")
    return c.add("prefixes", "SELECT root, prefix AS album_prefix, support FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY length(prefix) DESC, support DESC, pos) AS r FROM pg) WHERE r = 1")


def majority(c: Chain, name: str, value: str) -> Chain:
    return c.add(name, f"SELECT root, v FROM (SELECT root, v, row_number() OVER (PARTITION BY root ORDER BY count(*) DESC, min(pos)) AS r FROM (SELECT root, pos, {value} AS v FROM p) WHERE v IS NOT NULL AND v <> '' GROUP BY root, v) WHERE r = 1")


def candidate_chain() -> Chain:
    c = majority(prefix(hints(chain())), "major", strip("album_artist"))
    seg = "CASE " + " ".join(f"WHEN contains(album_prefix, {q(s)}) THEN {strip(f'split_part(album_prefix, {q(s)}, 1)')}" for s in PREFIX_SEPARATORS) + " END"
    c.then(f"SELECT h.*, split_hints >= 2 OR filename_hints >= 2 AS allow_split, album_prefix, v AS majority_artist, CASE WHEN length({seg}) >= 2 THEN {seg} END AS prefix_artist FROM h JOIN hinted USING (root) LEFT JOIN prefixes USING (root) LEFT JOIN major USING (root)")
    c.then(f"SELECT *, coalesce(title, '') AS t, coalesce(artist, '') AS a, {detect('title', 'artist')} AS original_flags, CASE WHEN {blank('title')} OR {like('coalesce(title, ' + q('') + ')', X.GENERIC)} THEN {filename('stem', 'allow_split')} END AS file FROM {{0}}")
    c.then(f"SELECT * REPLACE (coalesce(file.title, t) AS t, CASE WHEN {blank('a')} AND file.artist IS NOT NULL THEN file.artist ELSE a END AS a), CASE WHEN file IS NULL THEN cast([] as varchar[]) WHEN {blank('a')} AND file.artist IS NOT NULL THEN ['title from filename: ' || file.title, 'artist from filename: ' || file.artist] ELSE ['title from filename: ' || file.title] END AS notes FROM {{0}}")

    def step(value: str, note: str) -> None:
        c.then(f"SELECT *, {value} AS new FROM {{0}}")
        c.then(f"SELECT * EXCLUDE (new) REPLACE (new AS t, CASE WHEN new <> t THEN list_append(notes, {q(note)}) ELSE notes END AS notes) FROM {{0}}")

    step(track_number("t"), "stripped track number")
    value, noted = separators("t")
    c.then(f"SELECT * REPLACE ({value} AS t, CASE WHEN {noted} THEN list_append(notes, 'normalized separators') ELSE notes END AS notes) FROM {{0}}")
    c.then("SELECT *, t AS before FROM {0}")
    rest = after("t", "length(album_prefix)")
    step(f"CASE WHEN coalesce(starts_with(lower(t), lower(album_prefix)) AND NOT {blank(rest)}, false) THEN {rest} ELSE t END", "stripped album prefix")
    back = f"(before <> t AND {blank('a')} AND prefix_artist IS NOT NULL)"
    c.then(f"SELECT * REPLACE (CASE WHEN {back} THEN prefix_artist ELSE a END AS a, CASE WHEN {back} THEN list_append(notes, 'artist from album prefix: ' || prefix_artist) ELSE notes END AS notes) FROM {{0}}")
    step(artist_prefix("t", ("a", "majority_artist")), "stripped artist prefix")
    step(junk_prefix("t"), "stripped junk prefix")
    step(junk_suffix("t"), "stripped junk suffix")
    c.then("SELECT *, t AS old FROM {0}")
    for k in (0, 1, 0, 1):
        c.then(f"SELECT * REPLACE ({tempo('t', k)} AS t) FROM {{0}}")
    c.then("SELECT * EXCLUDE (old) REPLACE (CASE WHEN old <> t THEN list_append(notes, 'stripped tempo') ELSE notes END AS notes) FROM {0}")
    step(original_mix("t"), "stripped original mix")
    left, right = strip("split_part(t, ' - ', 1)"), strip("substr(t, strpos(t, ' - ') + 3)")
    fit = f"allow_split AND ({blank('a')} OR lower({strip('a')}) = lower({strip('t')})) AND contains(t, ' - ') AND length({left}) >= 2 AND length({right}) >= 2 AND NOT contains({right}, ' - ')"
    c.then(f"SELECT * REPLACE (CASE WHEN {fit} THEN {left} ELSE a END AS a, CASE WHEN {fit} THEN {right} ELSE t END AS t, CASE WHEN {fit} THEN list_append(notes, CASE WHEN {blank('a')} THEN 'artist from title: ' ELSE 'artist was the title, now: ' END || {left}) ELSE notes END AS notes) FROM {{0}}")
    c.then(f"SELECT * REPLACE ({squeeze('t')} AS t, {squeeze('a')} AS a) FROM {{0}}")
    t_case = f"({like('t', '\\p{L}')} AND NOT {symbolic('t')} AND (t = lower(t) OR t = upper(t) AND length(t) > 3))"
    a_case = f"({like('a', '\\p{L}')} AND NOT {like('a', '[0-9]')} AND a = lower(a) AND a <> upper(a))"
    c.then(f"SELECT * REPLACE (CASE WHEN {t_case} THEN {title_case('t')} ELSE t END AS t, CASE WHEN {a_case} THEN {title_case('a')} ELSE a END AS a) FROM {{0}}")
    c.then(f"SELECT *, {detect('t', 'a')} AS remaining_flags, CASE WHEN t <> '' AND t <> coalesce(title, '') THEN t END AS proposed_title, CASE WHEN a <> '' AND a <> coalesce(artist, '') THEN a END AS proposed_artist FROM {{0}}")
    return c.add("cand", f"SELECT *, cast(CASE WHEN {overlap('remaining_flags', BLOCKING)} THEN 0.3 WHEN t = coalesce(title, '') AND a = coalesce(artist, '') THEN 1.0 WHEN {blank('artist')} AND NOT {blank('a')} THEN 0.75 ELSE 0.9 END as double) AS confidence FROM {c.last}")


def class_chain() -> Chain:
    c = candidate_chain()
    count = lambda these: f"len(list_filter(original_flags, lambda f: f IN ({names(these)})))"
    bad = overlap("remaining_flags", ("unreadable_title", "generic_track_name"))
    c.add("alb", f"SELECT root, count(*) AS n, round(greatest(0, 1 - sum({count(HARD)} * 4 + {count(SOFT)}) FILTER ({SAMPLED}) / (10.0::double * count(*) FILTER ({SAMPLED}))), 3) AS score, bool_or(proposed_title IS NOT NULL OR proposed_artist IS NOT NULL) AS any_change, bool_and(confidence >= 0.75) AS confident, bool_or({overlap('remaining_flags', BLOCKING)}) AS blocked, count(*) FILTER ({bad}) AS bad FROM cand GROUP BY root")
    c.add("alc", "SELECT *, CASE WHEN score >= 0.9 AND NOT any_change THEN 'clean' WHEN score >= 0.6 AND confident AND NOT blocked THEN 'deterministic' WHEN bad * 2 > n THEN 'broken' ELSE 'mixed' END AS class, (cast(round(score * 1000) as bigint) + 5) // 10 AS h FROM alb")
    two = "(cast(h // 100 as varchar) || '.' || lpad(cast(h % 100 as varchar), 2, '0'))"
    mixed = f"concat_ws('; ', CASE WHEN score < 0.6 THEN 'probe ' || {two} || ' < deterministic_threshold 0.60' END, CASE WHEN NOT confident THEN 'low-confidence deterministic candidates' END, CASE WHEN blocked THEN 'blocking remaining flags present' END)"
    return c.add("cls", f"SELECT root, score, class, CASE class WHEN 'clean' THEN 'probe ' || {two} || ' ≥ clean_threshold 0.90 and no rule changes' WHEN 'deterministic' THEN 'probe ' || {two} || ' ≥ deterministic_threshold 0.60; all candidates confident and no blocking remaining flags' WHEN 'broken' THEN 'majority of tracks have unreadable/generic titles after deterministic pass' ELSE CASE WHEN {mixed} = '' THEN 'mixed evidence' ELSE {mixed} END END AS class_reason FROM alc")


def suggestion_chain() -> Chain:
    c = class_chain()
    action = f"CASE WHEN class = 'clean' THEN 'keep' WHEN proposed_title IS NOT NULL OR proposed_artist IS NOT NULL THEN 'propose_fix' WHEN list_contains(remaining_flags, 'unreadable_title') THEN {q(MANUAL)} ELSE 'keep' END"
    return c.add("sugg", f"""SELECT root, path, pos, ext, class, score, title AS current_title, artist AS current_artist,
      CASE WHEN class = 'clean' THEN title ELSE coalesce(proposed_title, title) END AS proposed_title, CASE WHEN class = 'clean' THEN artist ELSE coalesce(proposed_artist, artist) END AS proposed_artist,
      {action} AS action, remaining_flags AS issue_flags, remaining_flags, CASE WHEN class = 'clean' THEN 1.0::double ELSE confidence END AS confidence,
      CASE WHEN class = 'clean' THEN 'album probe clean; no change needed' WHEN len(notes) = 0 THEN 'no changes proposed' ELSE array_to_string(notes, '; ') END AS reason,
      CASE WHEN class = 'clean' THEN 'none' ELSE 'deterministic' END AS source FROM cand JOIN cls USING (root)""")


def changed(p: str, c: str) -> str:
    return f"({p} IS NOT NULL AND {p} <> coalesce({c}, ''))"


def validate(c: Chain, source: str) -> Chain:
    toks = lambda s: f"list_filter(regexp_split_to_array(lower(coalesce({s}, '')), {q(f'[{X.SPACES}\\-_/]+')}), lambda w: length(w) > 1)"
    apart = lambda a, b: f"(len({toks(a)}) > 0 AND len({toks(b)}) > 0 AND NOT list_has_any({toks(a)}, {toks(b)}))"
    c.add("v0", f"SELECT *, cast(NULL as varchar) AS downgraded_from, cast([] as varchar[]) AS validator_notes FROM {source}")

    def rule(when: str, note: str, cap: float | None = None, down: bool = False, **sets: str) -> None:
        sets["validator_notes"] = f"list_append(validator_notes, {q(note)})"
        if cap is not None:
            sets["confidence"] = f"least(confidence, {cap}::double)"
        if down:
            sets["downgraded_from"] = f"CASE WHEN action <> {q(MANUAL)} THEN coalesce(downgraded_from, action) ELSE downgraded_from END"
            sets["action"] = q(MANUAL)
        c.then(f"SELECT *, coalesce({when}, false) AS hit FROM {{0}}")
        c.then("SELECT * EXCLUDE (hit) REPLACE (" + ", ".join(f"CASE WHEN hit THEN {v} ELSE {k} END AS {k}" for k, v in sets.items()) + ") FROM {0}")

    rule(f"source = 'llm' AND proposed_title IS NOT NULL AND {symbolic('current_title')} AND {strip('proposed_title')} <> {strip('coalesce(current_title, ' + q('') + ')')}", "rejected edit of symbolic title", 0.3, proposed_title="current_title")
    c.then(f"SELECT *, {changed('proposed_title', 'current_title')} OR {changed('proposed_artist', 'current_artist')} AS live FROM {{0}}")
    rule("NOT live AND action = 'propose_fix'", "no effective change, marked keep", action="'keep'")
    rule(f"live AND proposed_title IS NOT NULL AND {blank('proposed_title')}", "rejected empty proposed_title", 0.3, True, proposed_title="current_title")
    rule(f"live AND proposed_artist IS NOT NULL AND {blank('proposed_artist')}", "rejected empty proposed_artist", 0.3, proposed_artist="current_artist")
    c.then(f"SELECT *, coalesce(proposed_title <> '' AND {like('proposed_title', X.GENERIC)}, false) AS generic FROM {{0}}")
    rule("live AND generic", "proposed title is still generic", 0.3, True)
    drop = lambda k: f"list_filter({k}, lambda f: f <> 'generic_track_name')"
    rule("live AND NOT generic AND proposed_title <> '' AND list_contains(remaining_flags, 'generic_track_name')", "removed spurious generic_track_name flag", remaining_flags=drop("remaining_flags"), issue_flags=drop("issue_flags"))
    rule(f"live AND proposed_title <> '' AND {unreadable('proposed_title')}", "proposed title still looks unreadable", None, True)
    c.then(f"SELECT *, {apart('current_title', 'proposed_title')} AND {apart('current_artist', 'proposed_artist')} AS rewritten FROM {{0}}")
    rule(f"live AND source = 'llm' AND rewritten AND ({changed('proposed_title', 'current_title')} OR {changed('proposed_artist', 'current_artist')})", "possible invention", 0.4)
    low = lambda k: f"lower({strip(f'coalesce({k}, {q(str())})')})"
    rule(f"live AND {low('current_title')} <> '' AND {low('current_artist')} <> '' AND {low('current_title')} = {low('proposed_artist')} AND {low('current_artist')} = {low('proposed_title')}", "artist/title look swapped", None, True, issue_flags="list_distinct(list_append(issue_flags, 'suspicious_swap_artist_title'))")
    rule("live AND confidence < 0.6 AND action = 'propose_fix'", "low confidence")
    rule(f"live AND rewritten AND {changed('proposed_title', 'current_title')} AND {changed('proposed_artist', 'current_artist')}", "both fields fully rewritten", None, True)
    return c.add("val", f"SELECT * FROM {c.last}")


def valid_chain() -> Chain:
    return validate(suggestion_chain(), "sugg")


def decided_chain() -> Chain:
    c = valid_chain().add("dec", DUCK_DECISIONS)
    return c.add("open", f"SELECT * FROM val WHERE action IN ({names(PENDING)}) AND NOT EXISTS (SELECT 1 FROM dec WHERE dec.root = val.root AND dec.path = val.path)")


def audit_chain() -> Chain:
    c = decided_chain()
    final = lambda f: f"CASE WHEN d.action = 'edit' THEN d.final_{f} WHEN v.action = {q(MANUAL)} THEN current_{f} ELSE proposed_{f} END"
    c.add("fin", f"SELECT v.root, v.path, v.ext, d.ord, d.action AS decision, current_title, current_artist, {final('title')} AS ft, {final('artist')} AS fa FROM dec d JOIN val v ON d.root = v.root AND d.path = v.path")
    c.add("wri", "SELECT *, CASE WHEN ft IS DISTINCT FROM current_title THEN ft END AS wt, CASE WHEN fa IS DISTINCT FROM current_artist THEN fa END AS wa FROM fin")
    c.add("ref", f"SELECT *, CASE WHEN decision = 'skip' THEN 'skipped by reviewer' WHEN wt IS NULL AND wa IS NULL THEN 'no change needed after edit' WHEN wt IS NOT NULL AND {blank('wt')} THEN 'refusing to write empty title' WHEN wa IS NOT NULL AND {blank('wa')} THEN 'refusing to write empty artist' WHEN ext NOT IN ('.flac', '.mp3', '.m4a', '.mp4', '.ogg', '.opus') THEN 'unsupported format' END AS note FROM wri")
    return c.add("aud", "SELECT root, path, ord, decision, CASE WHEN decision <> 'skip' THEN wt END AS applied_title, CASE WHEN decision <> 'skip' THEN wa END AS applied_artist, current_title AS previous_title, current_artist AS previous_artist, decision = 'skip' OR (wt IS NULL AND wa IS NULL) OR note IS NULL AS success, note, false AS dry_run FROM ref")


def merge_chain() -> Chain:
    c = suggestion_chain().add("resp", DUCK_RESPONSES)
    wrong = ("CASE WHEN json_type(e) <> 'OBJECT' THEN 'entry is not an object' WHEN coalesce(json_type(e, '$.track_path') <> 'VARCHAR' OR e->>'$.track_path' = '', true) THEN 'missing track_path' "
             "WHEN coalesce((e->>'$.action') NOT IN ('keep', " + names(PENDING) + "), true) THEN 'unknown action' WHEN coalesce(NOT (try_cast(e->>'$.confidence' as double) BETWEEN 0 AND 1), true) THEN 'bad confidence' "
             "WHEN coalesce(json_type(e, '$.issue_flags') <> 'ARRAY', true) THEN 'issue_flags is not a list' WHEN coalesce(json_type(e, '$.proposed_title'), 'NULL') NOT IN ('VARCHAR', 'NULL') OR coalesce(json_type(e, '$.proposed_artist'), 'NULL') NOT IN ('VARCHAR', 'NULL') THEN 'proposal is not a string' END")
    c.add("chk", f"SELECT root, chunk, raw, CASE WHEN NOT json_valid(raw) THEN 'not JSON' WHEN json_type(raw) <> 'OBJECT' THEN 'not an object' WHEN coalesce(json_type(raw, '$.tracks'), '') <> 'ARRAY' THEN 'tracks is not a list' ELSE list_filter(list_transform(cast(json_extract(raw, '$.tracks') as json[]), lambda e: {wrong}), lambda r: r IS NOT NULL)[1] END AS reason FROM resp")
    c.add("ent", "SELECT root, unnest(cast(json_extract(raw, '$.tracks') as json[])) AS e FROM chk WHERE reason IS NULL")
    c.add("rows_", "SELECT root, e->>'$.track_path' AS path, e->>'$.action' AS m_action, e->>'$.proposed_title' AS m_title, e->>'$.proposed_artist' AS m_artist, cast(e->>'$.confidence' as double) AS m_confidence, list_filter(cast(json_extract(e, '$.issue_flags') as varchar[]), lambda f: f = 'scene_junk') AS m_flags FROM ent")
    hit, missing = "(g.root IS NOT NULL AND m_action IS NOT NULL)", "(g.root IS NOT NULL AND m_action IS NULL)"
    return c.add("mer", f"""SELECT s.root, s.path, pos, current_title, current_artist,
      CASE WHEN {hit} THEN coalesce(nullif(m_title, ''), current_title) ELSE proposed_title END AS proposed_title, CASE WHEN {hit} THEN coalesce(nullif(m_artist, ''), current_artist) ELSE proposed_artist END AS proposed_artist,
      CASE WHEN {hit} THEN m_action WHEN {missing} THEN 'keep' ELSE action END AS action, CASE WHEN {hit} THEN m_confidence WHEN {missing} THEN 0.5::double ELSE confidence END AS confidence,
      CASE WHEN {hit} THEN m_flags ELSE issue_flags END AS issue_flags, CASE WHEN {hit} THEN m_flags ELSE remaining_flags END AS remaining_flags,
      CASE WHEN {hit} THEN 'llm' WHEN {missing} THEN 'deterministic' ELSE source END AS source
      FROM sugg s LEFT JOIN (SELECT root, chunk FROM chk WHERE reason IS NULL) g ON g.root = s.root AND g.chunk = s.pos // 2 LEFT JOIN rows_ r ON r.root = s.root AND r.path = s.path""")


def text(c: str) -> str:
    return f"array_to_string({c}, ';') AS {c}"


def top_issues(rows: str) -> str:
    return f"(SELECT coalesce(string_agg(flag || '=' || k, ';' ORDER BY k DESC, flag), '') FROM (SELECT flag, count(*) AS k FROM (SELECT unnest(issue_flags) AS flag FROM {rows}) GROUP BY flag ORDER BY k DESC, flag LIMIT 15))"


def title_rule(value: str) -> str:
    return f"SELECT path, {value} AS value FROM ({DUCK_TRACKS})"


def _fingerprints(tracks: str) -> str:
    part = f"SELECT root, left(md5(path), 2) AS part, sha1(string_agg(line, chr(10) ORDER BY line)) AS h FROM (SELECT root, path, path || chr(0) || cast(mtime_us as varchar) || chr(0) || cast(size_bytes as varchar) AS line FROM ({tracks})) GROUP BY root, part"
    return f"SELECT root, sha1(string_agg(part || ':' || h, chr(10) ORDER BY part || ':' || h)) AS fingerprint FROM ({part}) GROUP BY root"


def _queries() -> dict[str, str]:
    count = lambda these: f"sum(len(list_filter(flags, lambda f: f IN ({names(these)}))))"
    probe = chain().add("f", f"SELECT *, {detect('title', 'artist')} AS flags FROM p WHERE {SAMPLED}")
    probe.add("g", f"SELECT root, count(*) AS n_sampled, {count(HARD)} AS hard_flags, {count(SOFT)} AS soft_flags, count(*) FILTER ({blank('title')}) AS empty_titles, string_agg(path, ';' ORDER BY pos) AS sampled_paths, coalesce(string_agg(filename || ': empty title', ';' ORDER BY pos) FILTER ({blank('title')}), '') AS notes FROM f GROUP BY root")
    table = majority(majority(chain(), "m1", "album"), "m2", "album_artist")
    twice = chain().then("SELECT path, coalesce(title, '') AS x FROM p")
    for k in (0, 1, 0, 1):
        twice.then(f"SELECT path, {tempo('x', k)} AS x FROM {{0}}")
    intish = lambda s: f"coalesce(try_cast(trim(split_part({s}, '/', 1)) as int), try_cast(left(split_part({s}, '/', 1), 4) as int))"
    return {
        "detect_issues": f"SELECT path, array_to_string({detect('title', 'artist')}, ';') AS flags FROM ({DUCK_TRACKS})",
        "issue_counts_top15": f"SELECT flag, count(*) AS n FROM (SELECT unnest({detect('title', 'artist')}) AS flag FROM ({DUCK_TRACKS})) GROUP BY flag ORDER BY n DESC, flag LIMIT 15",
        "album_sample": chain().sql(f"SELECT root, path, pos, n FROM p WHERE {SAMPLED}"),
        "album_probe_score": probe.sql("SELECT *, round(greatest(0, 1 - (hard_flags * 4 + soft_flags) / (10.0::double * n_sampled)), 3) AS score FROM g"),
        "album_majority": majority(chain(), "m", "album_artist").sql("SELECT root, v AS album_artist FROM m"),
        "album_common_prefix": prefix(chain()).sql("SELECT * FROM prefixes"),
        "album_split_support": hints(chain()).sql("SELECT root, split_hints FROM hinted"),
        "album_filename_support": hints(chain()).sql("SELECT root, filename_hints, split_hints >= 2 OR filename_hints >= 2 AS allow_split FROM hinted"),
        "album_table": table.sql("SELECT g.root, left(sha1(replace(g.root, '/lib/', '')), 12) AS album_id, coalesce(m1.v, split_part(g.root, '/', 4)) AS album_name, m2.v AS album_artist, tracks FROM (SELECT root, count(*) AS tracks FROM p GROUP BY root) g LEFT JOIN m1 USING (root) LEFT JOIN m2 USING (root)"),
        "album_fingerprint": _fingerprints(DUCK_TRACKS),
        "changed_albums": f"SELECT a.root, CASE WHEN b.root IS NULL THEN 'new' WHEN a.fingerprint = b.fingerprint THEN 'unchanged' ELSE 'changed' END AS status FROM ({_fingerprints(DUCK_TRACKS)}) a LEFT JOIN ({_fingerprints(DUCK_PREVIOUS)}) b ON a.root = b.root",
        "filename_parse": f"SELECT path, x.artist AS artist, x.title AS title FROM (SELECT path, {filename('stem', 'l_linenumber % 2 = 0')} AS x FROM (SELECT *, {STEM} AS stem FROM ({DUCK_TRACKS})))",
        "strip_track_number": title_rule(track_number("coalesce(title, '')")),
        "normalize_separators": title_rule(separators("coalesce(title, '')")[0]),
        "strip_tempo": twice.sql("SELECT path, x AS value FROM {0}"),
        "strip_original_mix": title_rule(original_mix("coalesce(title, '')")),
        "smart_title_case": title_rule(title_case("coalesce(title, '')")),
        "track_candidates": candidate_chain().sql(f"SELECT path, proposed_title, proposed_artist, {text('notes')}, {text('original_flags')}, {text('remaining_flags')}, confidence FROM cand"),
        "album_classification": class_chain().sql("SELECT * FROM cls"),
        "suggestions": suggestion_chain().sql(f"SELECT path, class, current_title, current_artist, proposed_title, proposed_artist, action, {text('issue_flags')}, confidence, reason, source FROM sugg"),
        "validated_suggestions": valid_chain().sql(f"SELECT path, proposed_title, proposed_artist, action, {text('issue_flags')}, {text('remaining_flags')}, confidence, downgraded_from, {text('validator_notes')} FROM val"),
        "pending_export": valid_chain().sql(f"SELECT left(sha1(replace(root, '/lib/', '')), 12) AS album_id, source, reason, path AS track_path, coalesce(current_title, '') AS current_title, coalesce(current_artist, '') AS current_artist, coalesce(proposed_title, '') AS proposed_title, coalesce(proposed_artist, '') AS proposed_artist, printf('%.2f', confidence) AS confidence, {text('issue_flags')} FROM val WHERE action IN ({names(PENDING)})"),
        "review_queue": decided_chain().sql("SELECT path, class, score, action, row_number() OVER (PARTITION BY root ORDER BY pos) AS i, count(*) OVER (PARTITION BY root) AS of FROM open"),
        "review_queue_all": decided_chain().sql("SELECT path, action, row_number() OVER (PARTITION BY root ORDER BY pos) AS i, count(*) OVER (PARTITION BY root) AS of FROM val WHERE NOT EXISTS (SELECT 1 FROM dec WHERE dec.root = val.root AND dec.path = val.path)"),
        "selected_albums": decided_chain().sql("SELECT path, class, action FROM val WHERE root IN (SELECT root FROM dec WHERE action = 'edit')"),
        "auto_approve": decided_chain().sql("SELECT path, 'approve' AS action, 'auto-approved' AS note FROM open WHERE action = 'propose_fix' AND source = 'deterministic' AND confidence >= 0.9 AND NOT " + overlap("CASE WHEN len(remaining_flags) > 0 THEN remaining_flags ELSE issue_flags END", ("generic_track_name", "unreadable_title", "suspicious_swap_artist_title"))),
        "cascade_decisions": decided_chain().sql("SELECT path, v AS action, 'bulk ' || v || CASE WHEN pos = 1 THEN '' ELSE ' (cascade)' END AS note FROM (SELECT *, CASE WHEN regexp_matches(root, '[02468]$') THEN 'skip' ELSE 'approve' END AS v FROM open) WHERE pos >= 1"),
        "latest_decisions": f"SELECT root, path, action, final_title, final_artist, note, ord FROM (SELECT *, row_number() OVER (PARTITION BY root, path ORDER BY ord DESC) AS r FROM ({DUCK_DECISIONS})) WHERE r = 1",
        "apply_audit": audit_chain().sql("SELECT * EXCLUDE (root) FROM aud"),
        "apply_counters": audit_chain().sql("SELECT (SELECT count(DISTINCT root) FROM val) AS albums, (SELECT count(DISTINCT root) FROM val WHERE root IN (SELECT root FROM dec)) AS albums_applied, (SELECT count(DISTINCT root) FROM val WHERE root NOT IN (SELECT root FROM dec)) AS albums_no_decisions, count(*) FILTER (success) AS ok, count(*) FILTER (NOT success) AS failed FROM aud"),
        "cleaned_tracks": audit_chain().sql("SELECT p.path, coalesce(x.t, title) AS title, coalesce(x.a, artist) AS artist, album, album_artist, track_number FROM p LEFT JOIN (SELECT root, path, arg_max(applied_title, ord) FILTER (applied_title IS NOT NULL) AS t, arg_max(applied_artist, ord) FILTER (applied_artist IS NOT NULL) AS a FROM aud WHERE success GROUP BY root, path) x ON x.root = p.root AND x.path = p.path"),
        "library_report": decided_chain().sql(f"""SELECT a.*, r.*, d.*, (SELECT count(*) FROM open) AS pending_review, {top_issues('val')} AS top_issues FROM
          (SELECT count(*) AS total_albums, count(*) FILTER (class = 'clean') AS clean_albums, count(*) FILTER (class = 'deterministic') AS deterministic_albums, count(*) FILTER (class = 'broken') AS broken_albums, count(*) FILTER (class = 'mixed') AS mixed_albums FROM cls) a,
          (SELECT count(*) AS total_tracks, count(*) FILTER (action = 'propose_fix') AS proposed, count(*) FILTER (action = {q(MANUAL)}) AS unreadable, count(*) FILTER (confidence < 0.6 AND action = 'propose_fix') AS low_confidence FROM val) r,
          (SELECT count(*) FILTER (action = 'approve') AS approved, count(*) FILTER (action = 'approve' AND note = 'auto-approved') AS auto_approved, count(*) FILTER (action = 'skip') AS skipped, count(*) FILTER (action = 'edit') AS edited FROM dec) d"""),
        "tag_flatten": f"SELECT path, nullif({strip('title')}, '') AS title, nullif({strip('artist')}, '') AS artist, album, album_artist, track_number, cast(l_linenumber % 2 + 1 as int) AS disc_number, {intish('cast(l_orderkey % 40 + 1980 as varchar)')} AS year FROM ({DUCK_TRACKS})",
        "model_batches": majority(majority(chain(), "m1", "album"), "m2", "album_artist").add("j", """SELECT root, pos, cast(pos // 2 as int) AS chunk, '{"path":"' || path || '","filename":"' || filename || '","track_number":' || track_number
          || ',"disc_number":' || coalesce(cast(disc_number as varchar), 'null') || ',"current_title":' || coalesce('"' || title || '"', 'null') || ',"current_artist":' || coalesce('"' || artist || '"', 'null') || '}' AS one FROM p""").sql(
            """SELECT j.root AS root, chunk, count(*) AS n, '{"album_id":"' || left(sha1(replace(j.root, '/lib/', '')), 12) || '","album_name":"' || coalesce(any_value(m1.v), split_part(j.root, '/', 4)) || '","album_artist":' || coalesce('"' || any_value(m2.v) || '"', 'null')
            || ',"album_folder":"' || j.root || '","tracks":[' || string_agg(one, ',' ORDER BY pos) || ']}' AS payload FROM j LEFT JOIN m1 ON m1.root = j.root LEFT JOIN m2 ON m2.root = j.root GROUP BY j.root, chunk"""),
        "model_response_check": merge_chain().sql("SELECT root, chunk, reason IS NULL AS ok, reason FROM chk"),
        "model_merge": merge_chain().sql(f"SELECT path, proposed_title, proposed_artist, action, confidence, {text('issue_flags')}, source FROM mer"),
        "model_merge_validated": validate(merge_chain(), "mer").sql(f"SELECT path, proposed_title, proposed_artist, action, confidence, source, {text('validator_notes')} FROM val"),
    }


SAFE = "action = 'propose_fix' AND source = 'deterministic' AND confidence >= 0.9 AND NOT " + overlap("CASE WHEN len(remaining_flags) > 0 THEN remaining_flags ELSE issue_flags END", ("generic_track_name", "unreadable_title", "suspicious_swap_artist_title"))


def routed_chain() -> Chain:
    """The merge, but with responses of mixed and broken albums that have one for every chunk only."""
    c = merge_chain()
    c.add("used", "SELECT a.root FROM (SELECT root, max(pos) // 2 + 1 AS chunks FROM sugg WHERE class IN ('mixed', 'broken') GROUP BY root) a JOIN (SELECT root, count(DISTINCT chunk) AS got FROM resp GROUP BY root) b USING (root) WHERE got = chunks")
    either = lambda k: f"CASE WHEN u.root IS NULL THEN s.{k} ELSE m.{k} END AS {k}"
    reason = "CASE WHEN u.root IS NULL OR g.root IS NULL THEN s.reason WHEN m.source = 'llm' THEN 'r' ELSE 'not in the model''s response; the rules'' values are shown' END AS reason"
    c.add("rou", f"SELECT s.root, s.path, s.pos, class, s.current_title, s.current_artist, {', '.join(map(either, ('proposed_title', 'proposed_artist', 'action', 'confidence', 'issue_flags', 'remaining_flags', 'source')))}, {reason}, u.root IS NOT NULL AS used_model FROM sugg s JOIN mer m ON m.root = s.root AND m.path = s.path LEFT JOIN used u ON u.root = s.root LEFT JOIN (SELECT root, chunk FROM chk WHERE reason IS NULL) g ON g.root = s.root AND g.chunk = s.pos // 2")
    return validate(c, "rou")


def _more() -> dict[str, str]:
    left, right = strip("split_part(t, ' - ', 1)"), strip("substr(t, strpos(t, ' - ') + 3)")
    status = f"SELECT a.root, coalesce(a.fingerprint = b.fingerprint, false) AS same FROM ({_fingerprints(DUCK_TRACKS)}) a LEFT JOIN ({_fingerprints(DUCK_PREVIOUS)}) b ON a.root = b.root"
    name = "CASE WHEN l_partkey % 13 = 0 THEN '.' || filename WHEN l_partkey % 7 = 0 THEN filename || '.txt' WHEN l_partkey % 3 = 0 THEN upper(filename) ELSE filename END"
    found = chain().add("li", f"SELECT p.*, root || '/' || ({name}) AS file, {name} AS name FROM p WHERE l_partkey % 13 <> 0 AND l_partkey % 7 <> 0")
    changed_only = routed_chain().add("same", status).add("kept", "SELECT * FROM val WHERE root NOT IN (SELECT root FROM same WHERE same)").add("dec", DUCK_DECISIONS)
    tokens = f"list_filter(string_split_regex(lower(coalesce({{0}}, '')), {q(f'[{X.SPACES}\\-_/]+')}), lambda x: length(x) > 1)"
    tt, ta = tokens.replace("{0}", "title"), tokens.replace("{0}", "artist")
    shown = ", ".join(f"coalesce({k}, '') AS {k}" for k in ("current_title", "proposed_title", "current_artist", "proposed_artist"))
    return {
        "review_sheet": valid_chain().sql(f"SELECT path AS track_path, action, printf('%.2f', confidence) AS confidence, {shown}, {text('issue_flags')}, reason FROM val"),
        "scan_counters": f"SELECT count(*) AS albums, count(*) FILTER (NOT same) AS written, count(*) FILTER (same) AS unchanged FROM ({status})",
        "incremental_suggestions": valid_chain().sql(f"SELECT path, proposed_title, proposed_artist, action, {text('issue_flags')}, {text('remaining_flags')}, confidence, downgraded_from, {text('validator_notes')} FROM val"),
        "incremental_scan": f"SELECT root, count(*) AS tracks, cast(CASE WHEN l_orderkey % 9 = 0 OR l_orderkey % 4 = 0 THEN 2 ELSE 1 END AS bigint) AS scan, count(*) AS kept_tracks FROM ({DUCK_TRACKS}) GROUP BY root, l_orderkey",
        "file_listing": found.sql("SELECT file AS path, size_bytes, mtime_us FROM li"),
        "path_parts": found.sql("SELECT file AS path, root, name AS filename, ext, left(sha1(replace(root, '/lib/', '')), 12) AS album_id FROM li"),
        "scan_with_tags": found.sql(f"SELECT file AS path, root, ext, size_bytes, CASE WHEN l_partkey % 3 <> 0 THEN nullif({strip('title')}, '') END AS title, CASE WHEN l_partkey % 3 <> 0 THEN nullif({strip('artist')}, '') END AS artist, CASE WHEN l_partkey % 3 <> 0 THEN track_number END AS track_number FROM li"),
        "approval_counters": decided_chain().sql(f"SELECT (SELECT count(DISTINCT root) FROM val) AS albums, (SELECT count(*) FROM val WHERE action IN ({names(PENDING)})) AS considered, (SELECT count(*) FROM val WHERE action IN ({names(PENDING)})) - count(*) AS already_decided, count(*) FILTER ({SAFE}) AS newly_approved FROM open"),
        "decision_log": decided_chain().sql(f"SELECT path, action, final_title, final_artist, note, ord FROM (SELECT *, row_number() OVER (PARTITION BY root, path ORDER BY ord DESC) AS r FROM dec) WHERE r = 1 UNION ALL SELECT path, 'approve', NULL, NULL, 'auto-approved', (SELECT max(ord) + 1 FROM dec) FROM open WHERE {SAFE}"),
        "orphan_decisions": f"SELECT path, action, ord FROM ({DUCK_DECISIONS}) d WHERE path NOT IN (SELECT path FROM ({DUCK_TRACKS}))",
        "document_reload": valid_chain().sql(f"SELECT path, cast(pos // 2 as int) AS part, class, pos, proposed_title, action, {text('issue_flags')}, {text('remaining_flags')}, downgraded_from, {text('validator_notes')}, confidence, source FROM val WHERE NOT regexp_matches(root, '7$')"),
        "document_quarantine": valid_chain().sql("""SELECT root, part, CASE right(root, 1) WHEN '1' THEN 'part 0: unknown action' WHEN '2' THEN 'part 0: proposed_artist is not a text' WHEN '3' THEN 'part 0: track_path is not a text'
          WHEN '4' THEN 'part 0: score is not a number' WHEN '5' THEN 'part 0: not JSON' ELSE 'parts are missing' END AS reason FROM (
          SELECT root, cast(pos // 2 as int) AS part, bool_or(pos >= 2) OVER (PARTITION BY root) AS several, bool_or(pos < 2 AND proposed_artist IS NOT NULL) OVER (PARTITION BY root) AS named, right(root, 1) AS d FROM val)
          WHERE d IN ('1', '3', '4', '5') OR d = '2' AND named OR d = '6' AND several AND part <> 1 GROUP BY root, part"""),
        "decision_reload": f"SELECT path, action, final_title, note, cast(2 as bigint) AS ord FROM ({DUCK_DECISIONS}) WHERE NOT regexp_matches(root, '7$') AND ord % 3 <> 0",
        "routed_suggestions": routed_chain().sql("SELECT path, class, proposed_title, action, confidence, source, reason, used_model FROM val"),
        "routed_report": changed_only.sql(f"""SELECT a.*, r.*, d.*,
          (SELECT count(*) FROM kept k WHERE action IN ({names(PENDING)}) AND NOT EXISTS (SELECT 1 FROM dec WHERE dec.root = k.root AND dec.path = k.path)) AS pending_review, {top_issues('kept')} AS top_issues,
          (SELECT count(*) FROM same WHERE same) AS skipped_unchanged, (SELECT count(DISTINCT root) FROM kept WHERE class = 'mixed' AND used_model) AS model_albums FROM
          (SELECT (SELECT count(*) FROM same) AS total_albums, count(*) FILTER (class = 'clean') AS clean_albums, count(*) FILTER (class = 'deterministic') AS deterministic_albums, count(*) FILTER (class = 'broken') AS broken_albums, count(*) FILTER (class = 'mixed') AS mixed_albums FROM (SELECT DISTINCT root, class FROM kept)) a,
          (SELECT count(*) AS total_tracks, count(*) FILTER (action = 'propose_fix') AS proposed, count(*) FILTER (action = {q(MANUAL)}) AS unreadable, count(*) FILTER (confidence < 0.6 AND action = 'propose_fix') AS low_confidence FROM kept) r,
          (SELECT count(*) FILTER (action = 'approve') AS approved, count(*) FILTER (action = 'approve' AND note = 'auto-approved') AS auto_approved, count(*) FILTER (action = 'skip') AS skipped, count(*) FILTER (action = 'edit') AS edited FROM dec WHERE root IN (SELECT root FROM kept)) d"""),
        "title_tests": f"SELECT path, {like('coalesce(title, ' + q('') + ')', X.GENERIC)} AS generic, {symbolic('title')} AS symbolic, {unreadable('title')} AS unreadable FROM ({DUCK_TRACKS})",
        "title_tokens": f"SELECT path, array_to_string({tt}, '|') AS tokens, len({tt}) > 0 AND len({ta}) > 0 AND NOT list_has_any({tt}, {ta}) AS apart FROM ({DUCK_TRACKS})",
        "split_artist_title": f"SELECT path, CASE WHEN fit THEN {left} END AS artist, CASE WHEN fit THEN {right} END AS title FROM (SELECT *, contains(t, ' - ') AND length({left}) >= 2 AND length({right}) >= 2 AND NOT contains({right}, ' - ') AS fit FROM (SELECT path, coalesce(title, '') AS t FROM ({DUCK_TRACKS})))",
        "strip_artist_prefix": f"SELECT path, {artist_prefix('t', ('artist', 'album_artist'))} AS value, CASE WHEN starts_with(lower(t), 'va - ') AND NOT {blank(after('t', '5'))} THEN {after('t', '5')} ELSE t END AS literal FROM (SELECT path, coalesce(title, '') AS t, artist, album_artist FROM ({DUCK_TRACKS}))",
        "strip_junk_prefix": title_rule(junk_prefix("coalesce(title, '')")),
        "strip_junk_suffix": title_rule(junk_suffix("coalesce(title, '')")),
    }


ORACLE_SQL: dict[str, str] = _queries() | _more()
ORACLE_SQL |= {"apply_audit_bucketed": ORACLE_SQL["apply_audit"], "apply_audit_written": ORACLE_SQL["apply_audit"], "streamed_decisions": ORACLE_SQL["latest_decisions"]}
