"""DuckDB SQL that states the queries' results independently; expressions are built as text."""

from __future__ import annotations

from memlake.functions import text as T
from memlake.functions.answers import INFERENCE_MARKERS
from memlake.functions.temporal import INFERENCE_PATTERNS


def _in(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def norm(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(trim({x})), '_', ' '), '\([^)]*\)', ' ', 'g'), '[^a-z0-9\s-]', ' ', 'g'), '\s+', ' ', 'g'))"


def canon(x: str) -> str:
    return f"array_to_string(list_filter(string_split({norm(x)}, ' '), lambda t: t <> '' AND t NOT IN {_in(T.ENTITY_STOPWORDS)}), ' ')"


def distinct(x: str) -> str:
    """First occurrences in order; x is a column's name."""
    return f"list_filter({x}, lambda e, i: list_position({x}, e) = i)"


def any_of(x: str, markers) -> str:
    return "(" + " OR ".join(f"contains({x}, '{m.replace(chr(39), chr(39) * 2)}')" for m in markers) + ")"


def stable_id(kind: str, *parts: str) -> str:
    return f"'{kind}_' || substr(sha1({' || chr(124) || chr(124) || '.join(f'CAST({p} AS VARCHAR)' for p in parts)}), 1, 16)"


def semantic(x: str) -> str:
    p = f"(' ' || lower({x}) || ' ')"
    out = []
    for concept, aliases, items in T.CONCEPTS:
        out += [f"CASE WHEN contains({p}, ' {a} ') THEN '{c}' END" for a, c in items]
        out.append(f"CASE WHEN {any_of(p, [f' {a} ' for a in [*aliases, *(i for i, _ in items)]])} THEN '{concept}' END")
    return f"list_filter([{', '.join(out)}], lambda v: v IS NOT NULL)"


def summarize(x: str, n: int) -> str:
    joined = rf"trim(regexp_replace(array_to_string(list_filter({x}, lambda t: trim(t) <> ''), ' '), '\s+', ' ', 'g'))"
    return f"CASE WHEN length({joined}) <= {n} THEN {joined} ELSE rtrim(substr({joined}, 1, {n - 3})) || '...' END"


def kind(atom_type: str, x: str) -> str:
    low = f"lower({x})"
    return (
        f"CASE WHEN {atom_type} = 'preference' THEN 'preference' WHEN {atom_type} IN ('goal', 'decision', 'open_loop') THEN 'plan' WHEN {atom_type} = 'relation' THEN 'relation' WHEN {atom_type} IN ('profile', 'identity', 'state') THEN 'state' "
        f"WHEN {any_of(low, ['prefer', 'favorite', 'dislike', 'love ', 'hate '])} THEN 'preference' WHEN {any_of(low, ['work as', 'job', 'works at', 'live in', 'lives in', 'located in', 'married', 'dating'])} THEN 'state' "
        f"WHEN {any_of(low, ['plan', 'goal', 'want to', 'need to', 'will ', 'should ', 'must '])} THEN 'plan' WHEN {any_of(low, ['because', 'therefore', 'related to', 'with ', 'between '])} THEN 'relation' ELSE 'event' END"
    )


def status(x: str) -> str:
    low = f"lower({x})"
    return f"CASE WHEN {any_of(low, ['maybe', 'might', 'possibly', 'unclear', 'unsure'])} THEN 'uncertain' WHEN {any_of(low, ['no longer', 'used to', 'previously', 'formerly', 'replaced', 'instead of', 'changed from', 'stopped'])} THEN 'superseded' ELSE 'active' END"


def value(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9\s]+', ' ', 'g'), '\s+', ' ', 'g'))"


def token_set(x: str) -> str:
    return f"list_filter(list_distinct(string_split({value(x)}, ' ')), lambda t: length(t) > 1)"


def jaccard(a: str, b: str) -> str:
    x, y = token_set(a), token_set(b)
    return f"CASE WHEN len({x}) = 0 OR len({y}) = 0 THEN 0.0 ELSE len(list_intersect({x}, {y}))::DOUBLE / len(list_distinct(list_concat({x}, {y}))) END"


_STAMP = "'%-I:%M %p on %-d %B, %Y'"
_N = "CAST(floor(value) AS BIGINT) % 7"

EV_TURNS = f"""ev_turns AS (SELECT 'ev' AS corpus_id, 'session-' || day(ts) AS session_id, 'User' || user_id AS speaker,
 CASE event_type WHEN 'signup' THEN CASE {_N} WHEN 0 THEN 'I live in City1 downtown.' WHEN 5 THEN 'My flat is located in Town5.' ELSE 'I live in City' || ({_N}) || '.' END
  WHEN 'purchase' THEN CASE {_N} WHEN 5 THEN 'Maybe my job is at Acme5.' ELSE 'My job: I work at Acme' || ({_N}) || '.' END
  WHEN 'view' THEN 'I prefer Brand' || ({_N}) || '.' WHEN 'click' THEN 'I want to visit City' || ({_N}) || ' for stress relief today.' ELSE 'The job failed with Code' || ({_N}) || '.' END AS text,
 strftime(ts, {_STAMP}) AS timestamp, ts AS moment, event_id AS event_no, row_number() OVER (ORDER BY ts, event_id) AS seq FROM events)"""

CONV_TURNS = "conv_turns AS (SELECT 'conv' AS corpus_id, 'session-' || conv_id AS session_id, coalesce(role, 'unknown') AS speaker, trim(coalesce(text, '')) AS text, turn AS seq FROM conversations WHERE trim(coalesce(text, '')) <> '')"

_NOISE = _in(sorted({*T.NOISE_WORDS, *T.KEYWORD_STOPWORDS}))


# RE2's \\b knows ASCII words alone. unicode() makes it hold for all scripts: a word with a letter beyond ASCII, which no pattern
# here can match, becomes one character that is no word's; a hyphen before it, after which a match may end, becomes _HYPHEN.
_HYPHEN = "qxzhyq"


def unicode(x: str) -> str:
    spaces = rf"regexp_replace({x}, '\p{{Z}}', ' ', 'g')"
    marks = rf"regexp_replace({spaces}, '[^\x00-\x7F\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]', chr(2), 'g')"
    word = r"[0-9A-Za-z_]*[^\x00-\x7F](?:[0-9A-Za-z_]|[^\x00-\x7F])*"
    hyphens = rf"regexp_replace({marks}, '-({word})', '{_HYPHEN} \1', 'g')"
    return f"regexp_replace({hyphens}, ' ?{word}', chr(1), 'g')"


def hyphens(x: str) -> str:
    return f"list_transform({x}, lambda v: replace(v, '{_HYPHEN}', '-'))"


def entity_ctes(source: str, text: str, out: str, whole: bool = False) -> str:
    """CTEs that add column ents to source; whole: texts of any script, not of ASCII alone."""
    words, lower, back = (unicode(text), unicode(f"lower({text})"), hyphens) if whole else (text, f"lower({text})", lambda x: x)
    phrases = back(rf"regexp_extract_all({words}, '\b(?:[A-Z][a-zA-Z0-9_-]{{1,}}(?:\s+[A-Z][a-zA-Z0-9_-]{{1,}}){{1,3}})\b')")
    single = back(rf"regexp_extract_all({words}, '\b[A-Z][a-zA-Z0-9_-]{{2,}}\b')")
    keywords = back(rf"regexp_extract_all({lower}, '\b[a-zA-Z][a-zA-Z0-9_-]{{3,}}\b')")
    return rf"""{out}_a AS (SELECT *, list_transform(regexp_extract_all({text}, '"([^"]{{2,80}})"', 1), lambda v: trim(v)) AS _q,
  {phrases} AS _p, list_filter({single}, lambda v: length(v) > 2) AS _s,
  list_filter({keywords}, lambda k: length(k) > 3 AND k NOT IN {_in(T.KEYWORD_STOPWORDS)}) AS _w FROM {source}),
 {out}_b AS (SELECT *, flatten(list_transform(_p, lambda v: string_split({canon('v')}, ' '))) AS _pp, list_filter({distinct('_w')}, lambda k: len(list_filter(_w, lambda j: j = k)) >= 2) AS _k FROM {out}_a),
 {out}_c AS (SELECT *, list_filter(list_transform(list_concat(list_concat(_q, _p), list_concat(list_filter(_s, lambda t: NOT coalesce(list_contains(_pp, {canon('t')}), false)), _k)), lambda v: {canon('v')}),
  lambda v: v <> '' AND len(list_filter(string_split_regex(v, '[^a-z0-9]+'), lambda t: t <> '' AND t NOT IN {_NOISE})) > 0) AS _e FROM {out}_b),
 {out} AS (SELECT * EXCLUDE (_q, _p, _s, _w, _pp, _k, _e), list_slice({distinct('_e')}, 1, 8) AS ents FROM {out}_c)"""


def refs_ctes(source: str, by: str, texts: str, out: str, limit: int) -> str:
    """CTE out(by, refs): the first distinct references of each row's list of texts, at most limit."""
    return f"""{out}_t AS (SELECT {by}, unnest({texts}) AS tx, generate_subscripts({texts}, 1) AS ti FROM {source}), {entity_ctes(f'{out}_t', 'tx', f'{out}_e')},
 {out}_s AS (SELECT *, {semantic('tx')} AS _sem FROM {out}_e), {out}_u AS (SELECT {by}, ti, unnest(list_concat(ents, _sem)) AS r, generate_subscripts(list_concat(ents, _sem), 1) AS ri FROM {out}_s),
 {out}_g AS (SELECT {by}, {canon('r')} AS ref, min(ti * 1000 + ri) AS place FROM {out}_u GROUP BY ALL), {out} AS (SELECT {by}, list_slice(list(ref ORDER BY place), 1, {limit}) AS refs FROM {out}_g WHERE ref <> '' GROUP BY {by})"""


def terms_ctes(source: str, text: str, out: str) -> str:
    """CTEs that add the list column terms, the query terms of text, to source."""
    tokens = rf"list_filter(string_split(trim(regexp_replace(regexp_replace(lower({text}), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda x: length(x) > 2)"
    alias = lambda x: "CASE " + " ".join(f"WHEN {x} = '{k}' THEN [{', '.join(repr(i) for i in v)}]" for k, v in T.QUERY_ALIASES.items()) + " ELSE [] END"
    bare = "replace(x, ' ', '')"
    return f"""{entity_ctes(source, text, f'{out}_e')}, {out}_b AS (SELECT *, list_filter(list_concat(list_concat(ents, {semantic(text)}), {tokens}), lambda x: x <> '' AND x NOT IN {_in(T.QUERY_STOPWORDS)}) AS _b FROM {out}_e),
 {out} AS (SELECT * EXCLUDE (_b), list_distinct(list_filter(flatten(list_transform(_b, lambda x: list_concat(list_concat([x, {bare}], CASE WHEN x LIKE '%s' AND length(x) > 4 THEN [substr(x, 1, length(x) - 1)] ELSE [] END), list_concat({alias('x')}, {alias(bare)})))), lambda x: x <> '')) AS terms FROM {out}_b)"""


def embedding(x: str) -> str:
    """catalogue.mock_embedding."""
    low = f"lower({x})"
    counts = ", ".join(f"((length({low}) - length(replace({low}, '{w}', ''))) / {len(w)})::DOUBLE" for w in MOCK_WORDS)
    return rf"[{counts}, len(list_filter(string_split_regex({low}, '\s+'), lambda w: w <> ''))::DOUBLE]"


def cosine(a: str, b: str) -> str:
    n = f"(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"
    return f"CASE WHEN {n} = 0 THEN 0.0 ELSE list_dot_product({a}, {b}) / {n} END"


#: The words that the mock embedding counts.
MOCK_WORDS = ("psychology", "mental health", "counseling", "dancing", "reading", "caroline", "daniel")


EVENTS = f"""{EV_TURNS}, ev_i AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS turn_index FROM ev_turns),
 {entity_ctes('ev_i', 'text', 'ev_e')},
 ev_s AS (SELECT *, {semantic("speaker || ': ' || text")} AS _sem FROM ev_e),
 ev AS (SELECT * EXCLUDE (_sem), {distinct('_sem')} AS sem, {stable_id('evt', 'corpus_id', 'session_id', 'turn_index', 'speaker', 'text')} AS event_id, {stable_id('raw', 'corpus_id', 'session_id', 'turn_index', 'speaker', 'text')} AS raw_span_id,
  list_concat(ents, {distinct('_sem')}) AS _r FROM ev_s),
 events_x AS (SELECT * EXCLUDE (_r), {distinct('_r')} AS refs, list_transform({distinct('_r')}, lambda v: {canon('v')}) AS canon_refs FROM ev)"""

_FAMILIES = (
    (0, "observation", 0.4, None),
    (2, "preference", 0.7, ("prefer", "like", "favorite", "favour", "dislike")),
    (3, "decision", 0.7, ("decide", "decision", "choose", "selected", "we will", "i will")),
    (4, "goal", 0.6, ("need to", "want to", "goal", "plan to", "should", "must")),
    (5, "open_loop", 0.6, ("todo", "follow up", "pending", "open question", "?")),
    (6, "error_fix", 0.7, ("error", "failed", "fix", "bug", "exception")),
)
ATOMS = (
    EVENTS
    + ", atoms_u AS ("
    + " UNION ALL ".join(f"SELECT *, {pos} AS atom_ord, '{t}' AS atom_type, {c}::DOUBLE AS confidence FROM events_x" + (f" WHERE {any_of('lower(text)', m)}" if m else "") for pos, t, c, m in _FAMILIES)
    + f"), atoms_x AS (SELECT *, {stable_id('atom', 'raw_span_id', 'atom_type', 'text')} AS atom_id, {kind('atom_type', 'text')} AS memory_kind, {status('text')} AS status FROM atoms_u)"
)

_LOW = "lower(text)"
_SLOTS = (
    f"[CASE WHEN {any_of(_LOW, ['live in', 'lives in', 'moved to', 'located in', 'based in', 'from '])} THEN 'location' END, CASE WHEN {any_of(_LOW, ['works at', 'work at', 'employed by', 'joined ', 'company'])} THEN 'employer' END, "
    f"CASE WHEN {any_of(_LOW, ['work as', 'works as', 'job', 'occupation', 'profession'])} THEN 'occupation' END, CASE WHEN {any_of(_LOW, ['married', 'dating', 'partner', 'boyfriend', 'girlfriend', 'spouse'])} THEN 'relationship_status' END, "
    "CASE WHEN memory_kind = 'preference' THEN 'preference' END, CASE WHEN memory_kind = 'plan' THEN 'plan' END, CASE WHEN memory_kind = 'relation' THEN 'relationship' END]"
)
SUBJECT = rf"CASE WHEN {_LOW} LIKE 'i %' OR {_LOW} LIKE 'i''%' OR {_LOW} LIKE 'my %' OR regexp_matches({_LOW}, '\b(i|my|me|i''m)\b') THEN {canon('speaker')} ELSE coalesce(canon_refs[1], {canon('speaker')}) END"
CANDIDATES = (
    ATOMS
    + f""", cand_s AS (SELECT *, list_filter({_SLOTS}, lambda s: s IS NOT NULL) AS _sl, {SUBJECT} AS subject, {value('text')} AS nv FROM atoms_x WHERE memory_kind IN ('state', 'preference', 'plan', 'relation')),
 cand_l AS (SELECT * EXCLUDE (_sl), CASE WHEN len(_sl) > 0 THEN _sl ELSE [atom_type] END AS slots FROM cand_s WHERE nv <> ''),
 cand_u AS (SELECT * EXCLUDE (slots), unnest(slots) AS slot, generate_subscripts(slots, 1) AS slot_ord FROM cand_l),
 cand_p AS (SELECT *, CASE WHEN slot IN ('location', 'employer', 'occupation', 'relationship_status', 'home_city') THEN 'singleton' ELSE 'multi' END AS policy FROM cand_u),
 cand AS (SELECT *, CASE WHEN policy = 'singleton' THEN {stable_id('obj', 'corpus_id', 'subject', 'slot')} ELSE {stable_id('obj', 'corpus_id', 'subject', 'slot', 'nv')} END AS object_id,
  row_number() OVER (ORDER BY seq, atom_ord, slot_ord) AS ord FROM cand_p)"""
)
_DECIDE = """CASE WHEN f.cur = k.nv THEN 'NONE' WHEN k.status <> 'active' THEN 'TENTATIVE' WHEN contains(k.nv, f.cur) THEN 'PATCH' WHEN contains(f.cur, k.nv) THEN 'NONE' ELSE 'SUPERSEDE' END"""
_REASON = f"""CASE WHEN f.cur = k.nv THEN 'same_normalized_value' WHEN k.status <> 'active' THEN 'candidate_not_active' WHEN contains(k.nv, f.cur) THEN 'candidate_more_specific' WHEN contains(f.cur, k.nv) THEN 'existing_more_specific'
 WHEN {jaccard('f.cur', 'k.nv')} <= 0.2 THEN 'singleton_slot_low_overlap' ELSE 'default_supersede' END"""
#: Recursive by step within each object; a multi object's steps are told by their number alone.
ACTIONS = (
    CANDIDATES
    + f""", ranked AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY ord) AS step FROM cand),
 fold AS (SELECT ord, object_id, step, nv AS cur, 'ADD' AS action, 'new_object' AS reason FROM ranked WHERE step = 1 AND policy = 'singleton'
  UNION ALL SELECT k.ord, k.object_id, k.step, CASE WHEN {_DECIDE} IN ('PATCH', 'SUPERSEDE') THEN k.nv ELSE f.cur END, {_DECIDE}, {_REASON} FROM fold f JOIN ranked k ON k.object_id = f.object_id AND k.step = f.step + 1),
 decided AS (SELECT ord, action, reason FROM fold UNION ALL SELECT ord, CASE WHEN step = 1 THEN 'ADD' ELSE 'NONE' END, CASE WHEN step = 1 THEN 'new_object' ELSE 'same_normalized_value' END FROM ranked WHERE policy = 'multi'),
 actions AS (SELECT r.*, d.action, d.reason, CASE WHEN d.action <> 'NONE' THEN {stable_id('ver', 'r.object_id', 'r.event_id', 'd.action', 'r.nv')} END AS own FROM ranked r JOIN decided d USING (ord)),
 acts AS (SELECT *, coalesce(own, last_value(CASE WHEN action <> 'TENTATIVE' THEN own END IGNORE NULLS) OVER (PARTITION BY object_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS version_id FROM actions),
 eff AS (SELECT own, lead(timestamp) OVER w AS valid_to, lead(own) OVER w IS NOT NULL AS replaced, lag(own) OVER w AS previous_version_id FROM actions WHERE action IN ('ADD', 'PATCH', 'SUPERSEDE') WINDOW w AS (PARTITION BY object_id ORDER BY ord)),
 vers AS (SELECT a.own AS version_id, a.object_id, a.corpus_id, a.event_id, a.action AS operation, a.nv, a.subject, a.slot, a.ord, a.confidence, a.subject || ' [' || a.slot || ']: ' || a.text AS summary,
  CASE WHEN a.action = 'TENTATIVE' THEN 'tentative' WHEN e.replaced THEN 'superseded' ELSE 'active' END AS status, a.timestamp AS valid_from, e.valid_to, CASE WHEN a.action IN ('PATCH', 'SUPERSEDE') THEN e.previous_version_id END AS previous_version_id
  FROM actions a LEFT JOIN eff e ON e.own = a.own WHERE a.action <> 'NONE'),
 objs AS (SELECT object_id, first(corpus_id) AS corpus_id, first(subject) AS subject, first(slot) AS slot, first(policy) AS policy, arg_min(memory_kind, ord) AS memory_kind, arg_max(own, ord) FILTER (WHERE action <> 'TENTATIVE') AS latest_version_id,
  arg_min(event_id, ord) AS created_at_event_id, arg_max(event_id, ord) AS updated_at_event_id FROM actions WHERE action <> 'NONE' GROUP BY object_id),
 lnk AS (SELECT *, CASE action WHEN 'ADD' THEN 'origin' WHEN 'NONE' THEN 'support' WHEN 'TENTATIVE' THEN 'tentative' ELSE 'update' END AS role FROM acts),
 links AS (SELECT DISTINCT {stable_id('link', 'object_id', 'event_id', 'atom_id', 'role')} AS link_id, corpus_id, object_id, version_id, event_id, session_id, atom_id, role FROM lnk),
 pairs AS (SELECT DISTINCT l.event_id, o.subject FROM links l JOIN objs o USING (object_id) UNION SELECT DISTINCT event_id, subject FROM (SELECT event_id, unnest(canon_refs) AS subject FROM events_x) WHERE subject IN (SELECT subject FROM objs)),
 ent_ev AS (SELECT p.subject, e.event_id, e.session_id, e.turn_index, e.speaker, e.text, e.timestamp, row_number() OVER (PARTITION BY p.subject ORDER BY e.session_id, e.turn_index DESC, e.event_id) AS rank FROM pairs p JOIN events_x e USING (event_id))"""
)


_AGAINST, _TOWARDS = ["failed", "not ", "no longer", "instead of", "replaced", "contradict"], ["support", "because", "therefore", "so that", "decision", "prefer"]
_REL = f"CASE WHEN {any_of('said', _AGAINST)} THEN 'contradicts' WHEN {any_of('said', _TOWARDS)} THEN 'supports' ELSE 'co_occurs_with' END"
_ATOM_REL = f"CASE WHEN {any_of('lower(text)', ['failed', 'not ', 'no longer', 'contradict'])} THEN 'contradicts' WHEN {any_of('lower(text)', ['instead', 'replace', 'supersede', 'updated', 'changed'])} THEN 'supersedes' ELSE 'supports' END"
EDGES = (
    ATOMS
    + f""", said AS (SELECT event_id, count(*) AS n FROM atoms_x GROUP BY event_id),
 ce AS (SELECT raw_span_id, list_filter({distinct('canon_refs')}, lambda x: x <> '') AS en, array_to_string(list_transform(range(n), lambda i: lower(text)), ' ') AS said FROM events_x JOIN said USING (event_id)),
 cp AS (SELECT raw_span_id, {_REL} AS rel, CASE WHEN {any_of('said', _AGAINST)} THEN 0.5 WHEN {any_of('said', _TOWARDS)} THEN 0.45 ELSE 0.4 END::DOUBLE AS k, en, unnest(range(1, len(en) + 1)) AS i FROM ce),
 cq AS (SELECT raw_span_id, rel, k, en[i] AS l, unnest(list_slice(en, i + 1, 8)) AS r FROM cp),
 ca AS (SELECT raw_span_id, atom_id, atom_type, {_ATOM_REL} AS rel, greatest(0.45, confidence)::DOUBLE AS k, unnest(list_slice(refs, 1, 4)) AS e FROM atoms_x),
 cb AS (SELECT * EXCLUDE (e), {canon('e')} AS e FROM ca),
 edges AS (SELECT {stable_id('edge', 'raw_span_id', 'l', 'r', 'rel')} AS edge_id, l AS src, rel AS relation, r AS dst, k AS confidence FROM cq
  UNION ALL SELECT {stable_id('edge', 'raw_span_id', 'atom_id', 'e', 'rel')}, atom_type, rel, e, k FROM cb WHERE e <> '')"""
)

SESSIONS = (
    ACTIONS
    + f""", held AS (SELECT DISTINCT l.session_id, o.object_id, o.subject, o.slot, v.summary, v.status FROM links l JOIN objs o USING (object_id) JOIN vers v ON v.version_id = o.latest_version_id),
 st AS (SELECT session_id, list(summary ORDER BY subject, slot, object_id) FILTER (WHERE status = 'active') AS states, list(object_id ORDER BY subject, slot, object_id) AS ids FROM held GROUP BY session_id),
 li AS (SELECT session_id, list(speaker || ': ' || text ORDER BY turn_index) AS lines, list(event_id ORDER BY turn_index) AS evs, list(timestamp ORDER BY turn_index) AS stamps, count(*) AS num_events FROM events_x GROUP BY session_id),
 both_ AS (SELECT li.*, coalesce(states, []) AS states, coalesce(ids, []) AS ids FROM li LEFT JOIN st USING (session_id)), stxt AS (SELECT *, list_concat(states, lines) AS t, list_concat(list_slice(states, 1, 4), list_slice(lines, 1, 4)) AS s FROM both_),
 {refs_ctes('stxt', 'session_id', 't', 'srefs', 16)},
 sess AS (SELECT {stable_id('snap', repr('ev'), repr('session'), 'session_id')} AS snapshot_id, session_id AS scope_id, {summarize('t', 760)} AS summary, {summarize('s', 180)} AS synopsis, list_slice(ids, 1, 24) AS object_ids,
  list_slice(evs, -24, -1) AS event_ids, list_slice(evs, -12, -1) AS child_ids, refs, stamps[1] || '..' || stamps[-1] AS time_range, num_events FROM stxt LEFT JOIN srefs USING (session_id))"""
)
ENTITIES = f"""act AS (SELECT subject, list(summary ORDER BY slot, object_id, coalesce(valid_from, ''), version_id) AS states FROM vers WHERE status = 'active' GROUP BY subject),
 ids AS (SELECT subject, list(object_id ORDER BY slot, object_id) AS ids FROM objs GROUP BY subject), rec AS (SELECT subject, list(speaker || ': ' || text ORDER BY rank DESC) AS lines, list(event_id ORDER BY rank DESC) AS evs, list(timestamp ORDER BY rank DESC) AS stamps FROM ent_ev WHERE rank <= 12 GROUP BY subject),
 etxt AS (SELECT i.subject, i.ids, evs, stamps, list_concat(coalesce(states, []), coalesce(lines, [])) AS t, list_concat(list_slice(coalesce(states, []), 1, 4), list_slice(coalesce(lines, []), 1, 4)) AS s FROM ids i LEFT JOIN act USING (subject) LEFT JOIN rec USING (subject)),
 enamed AS (SELECT subject, list_concat([subject], t) AS t FROM etxt), {refs_ctes('enamed', 'subject', 't', 'erefs', 16)},
 enty AS (SELECT {stable_id('snap', repr('ev'), repr('entity'), 'subject')} AS snapshot_id, subject AS scope_id, {summarize('t', 760)} AS summary, {summarize('s', 180)} AS synopsis, list_slice(ids, 1, 32) AS object_ids, evs AS event_ids, refs,
  stamps[1] || '..' || stamps[-1] AS time_range FROM etxt LEFT JOIN erefs USING (subject))"""

ROOT = f"""rp AS (SELECT list_concat((SELECT list(summary ORDER BY scope_id) FROM (SELECT * FROM sess ORDER BY scope_id DESC LIMIT 6)), coalesce((SELECT list(summary ORDER BY scope_id) FROM (SELECT * FROM enty ORDER BY scope_id LIMIT 6)), [])) AS t, 'ev' AS corpus_id),
 {refs_ctes('rp', 'corpus_id', 't', 'rrefs', 20)}, rtail AS (SELECT list(event_id ORDER BY session_id, turn_index) AS evs FROM (SELECT * FROM events_x ORDER BY session_id DESC, turn_index DESC LIMIT 24)),
 root AS (SELECT {stable_id('snap', repr('ev'), repr('root'))} AS snapshot_id, {summarize('list_slice(t, 1, 6)', 220)} AS synopsis, {summarize('t', 900)} AS summary, evs AS event_ids,
  list_concat((SELECT list(snapshot_id ORDER BY scope_id) FROM sess), coalesce((SELECT list(snapshot_id ORDER BY scope_id) FROM (SELECT * FROM enty ORDER BY scope_id LIMIT 24)), [])) AS child_ids, refs,
  (SELECT arg_min(timestamp, (session_id, turn_index)) || '..' || arg_max(timestamp, (session_id, turn_index)) FROM events_x) AS time_range, (SELECT count(*) FROM events_x) AS num_events, (SELECT count(*) FROM sess) AS num_sessions, (SELECT count(*) FROM enty) AS num_entities
  FROM rp JOIN rrefs USING (corpus_id) CROSS JOIN rtail)"""

_MONTHS = "january february march april may june july august september october november december".split()
_DAY = lambda m: rf"coalesce(nullif(regexp_extract(low, '\b(\d{{1,2}})(?:st|nd|rd|th)?\s+{m}\b', 1), ''), nullif(regexp_extract(low, '\b{m}\s+(\d{{1,2}})(?:st|nd|rd|th)?\b', 1), ''))::INTEGER"


def questions(rows) -> str:
    """CTEs that analyse questions (qid, question): q."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    listed = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in rows)
    month, day = (" ".join(rf"WHEN regexp_matches(low, '\b{m}\b') THEN {v}" for m, v in pairs) for pairs in ([(m, i + 1) for i, m in enumerate(_MONTHS)], [(m, _DAY(m)) for m in _MONTHS]))
    return rf"""q_in AS (SELECT qid, question, lower(question) AS low FROM (VALUES {listed}) v(qid, question)), {terms_ctes('q_in', 'question', 'q_t')},
 q_h AS (SELECT qid, terms, ents AS entities, low, nullif(regexp_extract(low, '\b(?:19|20)\d{{2}}\b'), '')::INTEGER AS y, CASE {month} END AS m, CASE {day} END AS d, {embedding('question')} AS q_embedding FROM q_t),
 q AS (SELECT *, y IS NOT NULL OR m IS NOT NULL OR d IS NOT NULL OR trim(low) LIKE 'how many %' AS diverse FROM q_h)"""


def overlap(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / len({a}) END"


TOP6 = f"""snap_u AS (SELECT snapshot_id, 'session' AS kind, scope_id, 'ev:' || scope_id AS title, synopsis, summary, refs, event_ids FROM sess UNION ALL SELECT snapshot_id, 'entity', scope_id, 'ev:' || scope_id, synopsis, summary, refs, event_ids FROM enty),
 snap_c AS (SELECT *, concat_ws(' ', title, synopsis, summary, array_to_string(list_slice(coalesce(refs, []), 1, 8), ' ')) AS said FROM snap_u), {terms_ctes('snap_c', 'said', 'snap_t')}, snap_e AS (SELECT * EXCLUDE (ents), {embedding('summary')} AS embedding FROM snap_t),
 top_s AS (SELECT q.qid, q.entities, s.* EXCLUDE (terms), round(0.35 * {overlap('q.terms', 's.terms')} + CASE WHEN kind = 'entity' AND (list_contains(q.entities, scope_id) OR list_contains(q.terms, scope_id)) THEN 0.4 ELSE 0.0 END + 0.8 * {cosine('q_embedding', 'embedding')}, 6) AS score FROM snap_e s CROSS JOIN q),
 top6 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, CASE kind WHEN 'entity' THEN 1 ELSE 2 END, scope_id) AS rank FROM top_s QUALIFY rank <= 6)"""
RANKED = f"""chosen AS (SELECT qid, unnest(event_ids) AS event_id FROM top6 UNION SELECT s.qid, e.event_id FROM (SELECT qid, scope_id AS subject FROM top6 WHERE kind = 'entity' UNION SELECT qid, unnest(entities) FROM top6) s JOIN ent_ev e ON e.subject = s.subject AND e.rank <= 12),
 ev_c AS (SELECT event_id, session_id, turn_index, speaker, text, moment, concat_ws(' ', text, array_to_string(canon_refs, ' ')) AS said FROM events_x), {terms_ctes('ev_c', 'said', 'ev_q')},
 scored AS (SELECT q.qid, q.diverse, e.event_id, e.session_id, e.turn_index, CAST(e.moment AS DATE) AS day, round(0.55 * {overlap('q.terms', 'e.terms')} + CASE WHEN q.y = year(e.moment) THEN 0.18 ELSE 0.0 END + CASE WHEN q.m = month(e.moment) THEN 0.28 ELSE 0.0 END + CASE WHEN q.d = day(e.moment) THEN 0.36 ELSE 0.0 END
   + CASE WHEN list_contains(q.entities, lower(trim(e.speaker))) THEN 0.22 ELSE 0.0 END + 0.9 * {cosine('q_embedding', embedding("e.speaker || ': ' || e.text"))} + CASE WHEN c.event_id IS NOT NULL THEN 0.15 ELSE 0.0 END, 6) AS score
   FROM ev_q e CROSS JOIN q LEFT JOIN chosen c ON c.qid = q.qid AND c.event_id = e.event_id),
 by_day AS (SELECT *, row_number() OVER (PARTITION BY qid, day ORDER BY score DESC, session_id, turn_index, event_id) AS nth FROM scored),
 spans AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN diverse AND nth > 1 THEN 1 ELSE 0 END, score DESC, session_id, turn_index, event_id) AS rank FROM by_day QUALIFY rank <= 8)"""


def answer_lines(text: str, n: int) -> str:
    """CTEs over conv_turns: each session's first text asks, all its texts are lines of facts; scored: (session_id, seq, line, score)."""
    trimmed = rf"trim(regexp_replace({text}, '[\s\x1c-\x1f\x{{85}}\p{{Z}}]+', ' ', 'g'))"
    cut = f"CASE WHEN length({trimmed}) <= {n} THEN {trimmed} ELSE rtrim(substr({trimmed}, 1, {n - 3})) || '...' END"
    tokens = lambda x: rf"list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda t: length(t) > 2))"
    year = rf"regexp_matches({unicode('line')}, '\b(19|20)\d{{2}}\b')"
    return f"""{CONV_TURNS}, asked AS (SELECT session_id, arg_min(text, seq) AS question FROM conv_turns GROUP BY session_id), {entity_ctes('asked', 'question', 'ask_e', True)},
 ask AS (SELECT session_id, ents AS qe, {tokens('question')} AS qt, {any_of('lower(question)', ['when', 'date', 'day', 'month', 'year', 'time'])} AS temporal, {any_of("' ' || lower(trim(question)) || ' '", INFERENCE_PATTERNS)} AS inference FROM ask_e),
 told AS (SELECT session_id, seq, {cut} AS line FROM conv_turns), {entity_ctes('told', 'line', 'told_e', True)},
 scored AS (SELECT session_id, seq, line, inference, 1.5 * len(list_intersect(qt, {tokens('line')})) + 2.5 * len(list_filter(qe, lambda e: list_contains(ents, e) OR contains(lower(line), e)))
  + CASE WHEN temporal THEN CASE WHEN {year} THEN 2.0 ELSE 0.0 END + CASE WHEN {any_of('lower(line)', _MONTHS)} THEN 1.5 ELSE 0.0 END + CASE WHEN contains(line, '[') AND contains(line, ']') THEN 1.0 ELSE 0.0 END ELSE 0.0 END
  + CASE WHEN inference THEN 1.5 + CASE WHEN {any_of('lower(line)', INFERENCE_MARKERS)} THEN 1.0 ELSE 0.0 END ELSE 0.0 END AS score FROM told_e JOIN ask USING (session_id) WHERE line <> ''),
 first_of AS (SELECT *, row_number() OVER (PARTITION BY session_id, lower(line) ORDER BY score DESC, seq) AS nth FROM scored)"""


def q(ctes: str, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes} {body}"
