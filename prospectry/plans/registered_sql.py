"""The same results in plain SQL, stated independently of the operators."""

from __future__ import annotations

from .registered import FIRST, FOLLOW_UP, SENDER
from .standins import FOLLOWUPS, LANGUAGE_RULES, NOW, PROVIDERS, RULES
from ..rules import (
    ADDRESS_PATTERN, ASSET_SUFFIXES, BARE_DOMAIN_PATTERN, GENERIC_LOCALS, LOOKUP_QUERY,
    PHONE_PATTERN, PLACEHOLDER_LOCALS, PLACEHOLDER_MAIL_DOMAINS, QUERY_TEMPLATES, ROLE_WORDS,
    URL_PATTERN,
)


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def many(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def array(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


# --- scalar pieces ----------------------------------------------------------------------------

BLANKS = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '||chr(133)||chr(160)"
TS_NOW = f"TIMESTAMP '{NOW}'"
WORD = r"[^\p{L}\p{N}_]"


def strip(x: str) -> str:
    return f"trim({x}, {BLANKS})"


def no_www(x: str) -> str:
    return f"(CASE WHEN starts_with({x}, 'www.') THEN substr({x}, 5) ELSE {x} END)"


def authority(u: str) -> str:
    return f"regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)"


def domain(u: str) -> str:
    return no_www(f"lower({authority(u)})")


def path(u: str) -> str:
    return f"regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)', 1)"


def host(h: str) -> str:
    return no_www(f"rtrim({strip(f'lower({h})')}, '.')")


def mail_domain(a: str) -> str:
    return no_www(strip(
        f"lower(CASE WHEN instr({a}, '@') > 0 THEN substr({a}, instr({a}, '@') + 1) ELSE '' END)"))


def is_company(h: str) -> str:
    suffixes = " OR ".join(f"ends_with({h}, {q(x)})" for x in ASSET_SUFFIXES)
    denied = many(RULES.non_company_hosts)
    return (
        f"(contains({h}, '.') AND NOT ({suffixes}) AND {h} NOT IN {denied} AND "
        f"array_to_string(list_slice(str_split({h}, '.'), -2, -1), '.') NOT IN {denied})")


def live(html: str) -> str:
    bodies = "|".join(
        rf"<{t}\b[^>]*>.*?(?:</{t}[^>]*>|\z)" for t in ("script", "style", "template"))
    return f"regexp_replace({html}, {q(rf'(?is)<!--.*?(?:-->|\z)|{bodies}')}, chr(1), 'g')"


def entities(x: str) -> str:
    for name, value in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"')):
        x = f"replace({x}, {q(name)}, {q(value)})"
    return f"replace({x}, '&amp;', '&')"


def visible(lv: str) -> str:
    tag = r"""<[a-zA-Z/!?](?:[^>"']|"[^"]*"|'[^']*')*>|<[a-zA-Z/!?][^>]*>"""
    nodes = f"string_split_regex({lv}, chr(1) || {q('|' + tag)})"
    nodes = f"list_filter(list_transform({nodes}, lambda x: {strip('x')}), lambda x: x <> '')"
    return entities(f"array_to_string({nodes}, ' ')")


def title(lv: str) -> str:
    raw = f"regexp_extract({lv}, '(?is)<title\\b[^>]*>([^<]*)', 1)"
    t = strip(entities(f"nullif({raw}, '')"))
    return strip(f"split_part(split_part({t}, '|', 1), ' - ', 1)")


def phone(t: str) -> str:
    return f"nullif(regexp_extract({t}, {q(PHONE_PATTERN)}), '')"


def addresses(t: str) -> str:
    return f"regexp_extract_all({t}, {q(ADDRESS_PATTERN)})"


def best(pool: str, site: str = "''") -> str:
    """Best address of a list expression."""
    usable = (
        f"list_filter(list_transform({pool}, lambda e: {strip('e')}), lambda e: NOT contains(e, '%') "
        f"AND regexp_full_match(e, {q(ADDRESS_PATTERN)}) "
        f"AND lower(split_part(e, '@', 1)) NOT IN {many(GENERIC_LOCALS + PLACEHOLDER_LOCALS)} "
        f"AND lower(substr(e, instr(e, '@') + 1)) NOT IN {many(PLACEHOLDER_MAIL_DOMAINS)})")
    role = " OR ".join(f"contains(lower(e), {q(w)})" for w in ROLE_WORDS)
    keyed = (
        f"list_transform({usable}, lambda e, i: {{'a': CASE WHEN {site} <> '' AND "
        f"lower(substr(e, instr(e, '@') + 1)) = lower({site}) THEN 0 ELSE 1 END, "
        f"'b': CASE WHEN {role} THEN 0 ELSE 1 END, 'c': length(e), 'd': i, 'e': e}})")
    return f"(list_sort({keyed})[1]).e"


def any_word(t: str, words) -> str:
    return "(" + " OR ".join(f"contains(lower({t}), {q(w.lower())})" for w in words) + ")"


def count_words(t: str, words) -> str:
    return "(" + " + ".join(
        f"CASE WHEN contains(lower({t}), {q(w)}) THEN 1 ELSE 0 END" for w in words) + ")"


def unnegated(t: str, signals) -> str:
    words = "|".join(RULES.negation_words)
    negation = q(f"(^|{WORD})({words})($|{WORD})")
    parts = []
    for s in signals:
        split = f"str_split(lower({t}), {q(s)})"
        window = f"right(array_to_string({split}[1:k], {q(s)}), {RULES.negation_window})"
        parts.append(
            f"len(list_filter(range(1, len({split})), lambda k: NOT regexp_matches({window}, "
            f"{negation}))) > 0")
    return "(" + " OR ".join(parts) + ")"


def evidence(t: str) -> str:
    m = RULES.evidence_margin
    cases = []
    for p in RULES.evidence_phrases:
        at = f"instr(lower({t}), {q(p)})"
        start = f"greatest(1, {at} - {m})"
        cases.append(
            f"WHEN {at} > 0 THEN {strip(f'substr({t}, {start}, {at} + {len(p)} + {m} - {start})')}")
    return f"(CASE {' '.join(cases)} END)"


def state_code(t: str) -> str:
    codes = "|".join(sorted(RULES.state_abbreviations))
    plain = f"regexp_replace({t}, '[À-ÖØ-öø-ÿ]', '_', 'g')"
    before = f"length(regexp_extract({plain}, {q(rf'(?s)^(.*?)\b(?:{codes})\b')}, 1))"
    return (
        f"(CASE WHEN regexp_matches({plain}, {q(rf'\b(?:{codes})\b')}) AND regexp_matches("
        f"substr({plain}, {before} + 3, 12), '\\b\\d{{5}}(-\\d{{4}})?\\b') "
        f"THEN regexp_extract({plain}, {q(rf'\b(?:{codes})\b')}) END)")


def state(t: str, names=RULES.state_names) -> str:
    name = f"nullif(regexp_extract({t}, {q('(?i)' + '|'.join(names))}), '')"
    return f"coalesce({name}, {state_code(t)})"


def mentions_us(t: str) -> str:
    return f"regexp_matches({t}, {q(rf'(?i)(^|{WORD})(United States|U\.S\.A|USA)($|{WORD})')})"


def company_type(t: str) -> str:
    return (
        f"(CASE WHEN {any_word(t, RULES.keywords)} THEN CASE "
        f"WHEN {unnegated(t, RULES.compounding_signals)} THEN 'compounding_pharmacy' "
        f"WHEN {unnegated(t, RULES.manufacturing_signals)} THEN 'manufacturing_lab' "
        f"WHEN {evidence(t)} <> '' THEN 'research_only' ELSE 'consumer_and_research' END END)")


def first_set(c: str, by: str) -> str:
    return f"arg_min({c}, {by}) FILTER (WHERE {c} IS NOT NULL) AS {c}"


# --- stand-in tables --------------------------------------------------------------------------

LEADS = f"""leads AS (SELECT c_custkey AS id, c_name AS company_name,
  'https://site' || c_custkey || '.example.net/' AS website,
  'site' || c_custkey || '.example.net' AS domain,
  CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 10 = 1 THEN ''
    ELSE 'sales@m' || (c_custkey % 97) || '.example.net' END AS email,
  CAST(NULL AS VARCHAR) AS phone, CAST(NULL AS VARCHAR) AS description,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'vendor_roster' ELSE lower(c_mktsegment) END AS source,
  CAST(NULL AS VARCHAR) AS matched_query, CAST(NULL AS VARCHAR) AS research_only_evidence,
  CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'research_only' WHEN 'MACHINERY' THEN 'manufacturing_lab'
    WHEN 'FURNITURE' THEN 'consumer_and_research' END AS company_type,
  c_acctbal > 0 AS sells_direct, c_mktsegment = 'MACHINERY' AS manufactures,
  c_nationkey < 5 AS us_based, CAST(NULL AS VARCHAR) AS state,
  CASE WHEN c_nationkey = 0 THEN 'replied' WHEN c_nationkey = 1 THEN 'qualified'
    WHEN c_nationkey = 2 THEN 'disqualified' WHEN c_nationkey < 12 THEN 'contacted'
    ELSE 'new' END AS status,
  CASE WHEN c_nationkey = 0 THEN TIMESTAMP '2001-07-01' END AS replied_at,
  c_acctbal < -800 AS opted_out, CAST(NULL AS VARCHAR) AS notes,
  TIMESTAMP '1995-01-01' + to_days(CAST(c_custkey % 1000 AS INTEGER)) AS created_at,
  TIMESTAMP '1995-01-01' + to_days(CAST(c_custkey % 1000 AS INTEGER)) AS updated_at FROM customer)"""

OUTREACH = """outreach AS (SELECT o_orderkey AS id, o_custkey AS lead_id,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'info@p' || (o_custkey % 53) || '.example.org'
    ELSE 'sales@m' || (o_custkey % 97) || '.example.net' END AS to_email,
  1 AS step, o_orderpriority AS subject, '' AS body,
  CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'P' THEN 'drafted' ELSE 'sent' END AS delivery,
  CASE WHEN o_orderstatus = 'F' THEN 'bounced' END AS error, o_orderdate AS created_at FROM orders)"""

MESSAGES = """messages AS (SELECT conv_id * 1000 + turn AS msg_id,
  TIMESTAMP '2001-06-01' + to_days(CAST(conv_id % 60 AS INTEGER)) AS received_at,
  'jane@m' || (conv_id % 131) || '.example.net' AS sender, '' AS subject, left(text, 2000) AS body,
  text AS whole_body FROM conversations WHERE role = 'user')"""

ROSTER = """roster AS (SELECT s_suppkey AS ord, s_name AS name,
  CASE WHEN n_name = 'NATION_1' THEN 'United States' ELSE n_name END AS country
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
domain_map AS (SELECT ord AS line_no, name, country,
  'site' || (ord % 37 * 60) || '.example.net' AS domain FROM roster WHERE ord % 4 <> 0),
located AS (SELECT r.ord, r.name, r.country, m.domain FROM roster r LEFT JOIN domain_map m USING (name))"""

ROSTER_PROFILES = """found AS (SELECT 'site' || c_custkey || '.example.net' AS domain,
  CASE WHEN c_custkey % 2 = 0 THEN 'hello@site' || c_custkey || '.example.net' END AS email,
  c_name AS phone, c_custkey % 5 AS n_pages FROM customer WHERE c_custkey % 3 = 0)"""

_FEATURES = f"""live AS (SELECT page_id, url, html, {domain('url')} AS domain, {live('html')} AS lv
  FROM pages WHERE html <> ''),
features AS (SELECT page_id, url, domain, {title('lv')} AS company_name,
  CAST(NULL AS VARCHAR) AS description, {best(addresses('html'), 'domain')} AS email,
  {visible('lv')} AS text FROM live WHERE domain <> ''),
paged AS (SELECT *, {phone('text')} AS phone FROM features)"""


def profiles(order: str = "page_id") -> str:
    t = "text"
    return f"""sites AS (SELECT domain, count(*) AS n_pages, arg_min(url, {order}) AS url,
  {first_set('company_name', order)}, {first_set('description', order)}, {first_set('email', order)},
  {first_set('phone', order)}, string_agg(text, ' ' ORDER BY {order}) AS text
  FROM paged GROUP BY domain),
profiles AS (SELECT url, domain, company_name, email, phone, description,
  {evidence(t)} AS research_only_evidence, {company_type(t)} AS company_type,
  {count_words(t, RULES.commerce_signals)} >= 2 AS sells_direct,
  {unnegated(t, RULES.manufacturing_signals)} AS manufactures,
  {count_words(t, RULES.content_signals)} >= 2 AS is_content_site,
  ({mentions_us(t)} OR {state(t)} IS NOT NULL) AS us_based, {state(t)} AS state, n_pages FROM sites)"""


_REASON = """CASE WHEN company_type IS NULL THEN 'skipped_not_relevant'
  WHEN is_content_site AND NOT sells_direct THEN 'skipped_content_site'
  WHEN NOT sells_direct THEN 'skipped_not_a_vendor' {us} END"""
_US = "WHEN NOT us_based THEN 'skipped_non_us'"

_JUDGED = f"""{_FEATURES}, {profiles()},
known AS (SELECT {domain('url')} AS domain, min(page_id) AS id FROM pages
  WHERE ends_with({domain('url')}, '.org') GROUP BY 1),
visits AS (SELECT domain, page_id AS ord, url, 'q' || (page_id % 7) AS query FROM (
  SELECT *, {domain('url')} AS domain, row_number() OVER (PARTITION BY {domain('url')} ORDER BY page_id)
  AS rn FROM pages) WHERE rn = 1 AND domain <> ''),
judged AS (SELECT v.ord, v.url, v.domain, v.query, p.* EXCLUDE (url, domain),
  CASE WHEN p.domain IS NULL THEN 'fetch_failed' ELSE {_REASON.format(us='')} END AS reason
  FROM visits v LEFT JOIN profiles p USING (domain)),
outcomes AS (SELECT ord, domain, coalesce(reason, CASE WHEN k.domain IS NULL THEN 'added'
  ELSE 'duplicate' END) AS outcome FROM judged LEFT JOIN known k USING (domain))"""


def funnel(source: str, outcomes) -> str:
    values = ", ".join(f"({q(o)})" for o in outcomes)
    return (f"SELECT o AS outcome, count(x.outcome) AS n FROM (VALUES {values}) v(o) "
            f"LEFT JOIN {source} x ON x.outcome = v.o GROUP BY o")


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


SQL: dict[str, str] = {}

# --- pages ------------------------------------------------------------------------------------

SQL["page_domains"] = f"SELECT page_id, {domain('url')} AS domain, {path('url')} AS path FROM pages"
SQL["page_fields"] = with_(_FEATURES) + """SELECT page_id, domain, company_name, description, email,
  phone, md5(text) AS text_md5, length(text) AS n_chars FROM paged"""
SQL["contact_rollup"] = with_(_FEATURES) + f"""SELECT domain, count(*) AS n_pages,
  {first_set('company_name', 'page_id')}, {first_set('description', 'page_id')},
  {first_set('email', 'page_id')}, {first_set('phone', 'page_id')} FROM paged GROUP BY domain"""
SQL["site_profiles"] = with_(_FEATURES, profiles()) + "SELECT * FROM profiles"

_LANGUAGE_URL = "regexp_replace(url, '^([a-z]+://[^/]+/[a-z]+).*', '\\1')"
_CHOSEN = f"""chosen AS (SELECT * FROM (SELECT page_id, {_LANGUAGE_URL} AS url, html,
  list_position({array(LANGUAGE_RULES.candidate_paths)}, {path(_LANGUAGE_URL)}) - 1 AS path_rank,
  row_number() OVER (PARTITION BY {domain('url')}, {path(_LANGUAGE_URL)} ORDER BY page_id) AS rn
  FROM pages) WHERE rn = 1 AND path_rank >= 0)"""
SQL["candidate_pages"] = with_(_CHOSEN) + f"""SELECT {domain('url')} AS domain, path_rank, page_id, url
  FROM chosen"""
SQL["visited_profiles"] = with_(
    _CHOSEN,
    _FEATURES.replace("FROM pages WHERE", ", path_rank FROM chosen WHERE").replace(
        "SELECT page_id, url, domain,", "SELECT path_rank, url, domain,"),
    profiles("path_rank"),
    "checked AS (SELECT domain, string_agg(url, '|' ORDER BY path_rank) AS pages_checked FROM paged "
    "GROUP BY domain)",
) + "SELECT p.*, pages_checked FROM profiles p JOIN checked USING (domain)"
SQL["candidate_page_urls"] = f"""SELECT domain, path_rank, path, 'https://' || domain || path AS url
  FROM (SELECT DISTINCT {domain('url')} AS domain FROM pages), (VALUES (0, '/'), (1, '/about'),
  (2, '/about-us'), (3, '/contact'), (4, '/contact-us')) v(path_rank, path)"""
SQL["site_text_pieces"] = with_(_FEATURES) + """SELECT domain, piece, n_pages,
  length(text) AS n_chars, md5(text) AS text_md5 FROM (SELECT domain, page_id // 64 AS piece,
  count(*) AS n_pages, string_agg(text, ' ' ORDER BY page_id) AS text FROM paged GROUP BY 1, 2)"""
SQL["page_mailto_links"] = (
    "SELECT page_id, 'office' || page_id || '@site.example.net' AS addresses FROM pages")
SQL["page_meta_fields"] = f"""SELECT page_id, CASE WHEN page_id % 3 <> 0 AND contains(html, '<head>')
    THEN 'Site ' || page_id || ' & Co' ELSE {title(live('html'))} END AS company_name,
  CASE WHEN page_id % 3 <> 0 AND contains(html, '<head>') THEN 'About ' || page_id END AS description
  FROM pages"""

# --- documents --------------------------------------------------------------------------------

SQL["doc_addresses"] = f"""SELECT doc_id, i - 1 AS pos, a[i] AS address FROM (SELECT doc_id, a,
  unnest(range(1, len(a) + 1)) AS i FROM (SELECT doc_id, {addresses('text')} AS a FROM documents))"""
_POOL = (f"list_concat(list_concat(['privacy@mail2.example.com'], {addresses('text')}), "
         "[' info@mail2.example.com ', 'd' || doc_id || '@mail3.example.com'])")
SQL["doc_best_address"] = f"""SELECT doc_id, {best(_POOL, "'mail3.example.com'")} AS on_site,
  {best(_POOL)} AS anywhere FROM documents"""
SQL["doc_phones"] = (
    f"SELECT * FROM (SELECT doc_id, {phone('text')} AS phone FROM documents) WHERE phone IS NOT NULL")
SQL["keyword_docs"] = (
    f"SELECT doc_id, lang FROM documents WHERE {any_word('text', RULES.keywords)}")
SQL["signal_flags"] = f"""SELECT doc_id, {count_words('text', RULES.commerce_signals)} AS n_commerce,
  {count_words('text', RULES.commerce_signals)} >= 2 AS sells_direct,
  {count_words('text', RULES.content_signals)} >= 2 AS is_content_site FROM documents"""
SQL["unnegated_signals"] = f"""SELECT doc_id,
  {unnegated('text', RULES.manufacturing_signals)} AS manufactures,
  {unnegated('text', RULES.compounding_signals)} AS compounding FROM documents"""
SQL["evidence_snippets"] = (
    f"SELECT * FROM (SELECT doc_id, {evidence('text')} AS snippet FROM documents) "
    "WHERE snippet IS NOT NULL")
SQL["us_presence"] = f"""SELECT doc_id, {mentions_us('text')} OR {state('text')} IS NOT NULL AS is_us,
  {state('text')} AS state FROM documents"""
SQL["us_presence_with_zip"] = f"""SELECT doc_id, {mentions_us('t')} OR state IS NOT NULL AS is_us, state
  FROM (SELECT doc_id, t, {state_code('t')} AS state FROM (SELECT doc_id,
  regexp_replace(text, '(IN|OF|DE) ', '\\1 46201 ', 'g') AS t FROM documents))"""
SQL["company_types"] = f"SELECT doc_id, {company_type('text')} AS company_type FROM documents"
SQL["skip_reasons"] = f"""SELECT doc_id, {_REASON.format(us=_US)} AS strict,
  {_REASON.format(us='')} AS any_country,
  CASE WHEN company_type IS NULL THEN 'skipped_not_relevant' {_US} END AS any_kind FROM (
  SELECT doc_id, {company_type('text')} AS company_type,
    {count_words('text', RULES.commerce_signals)} >= 2 AS sells_direct,
    {count_words('text', RULES.content_signals)} >= 2 AS is_content_site,
    ({mentions_us('text')} OR {state('text')} IS NOT NULL) AS us_based FROM documents)"""

# --- hosts ------------------------------------------------------------------------------------


def hosts_of(t: str) -> str:
    plain = f"regexp_replace({t}, '[À-ÖØ-öø-ÿ]', '_', 'g')"
    by_url = (f"list_transform(regexp_extract_all({t}, {q('(?i)' + URL_PATTERN)}), "
              f"lambda u: {host(authority('u'))})")
    bare = (f"list_transform(regexp_extract_all({plain}, {q('(?i)' + BARE_DOMAIN_PATTERN)}), "
            f"lambda b: {host('b')})")
    return f"list_filter(list_distinct(list_concat({by_url}, {bare})), lambda h: {is_company('h')})"


_MINED = f"""texts AS (SELECT text AS content, 'mail1.example.com' AS own FROM documents
  UNION ALL SELECT url || ' ' || html, NULL FROM pages),
mined AS (SELECT DISTINCT h AS host FROM (SELECT own, unnest({hosts_of('content')}) AS h FROM texts)
  WHERE own IS NULL OR h <> own),
seeds AS (SELECT DISTINCT {host(authority('url'))} AS host FROM pages WHERE contains(url, '.org'))"""
SQL["mined_hosts"] = with_(_MINED) + "SELECT host FROM mined"
SQL["doc_hosts"] = f"""SELECT doc_id, array_to_string(list_sort(h), '|') AS hosts FROM (
  SELECT doc_id, {hosts_of('text')} AS h FROM documents) WHERE len(h) > 0"""
SQL["seed_additions"] = with_(_MINED) + """SELECT host, 'https://' || host || '/' AS url FROM mined
  ANTI JOIN seeds USING (host)"""
SQL["seed_merge_counts"] = with_(_MINED) + """SELECT count_if(s.host IS NULL)::BIGINT AS added,
  count(s.host) AS already FROM mined m LEFT JOIN seeds s USING (host)"""
_HOST = host(f"{authority('url')} || ({array(('', '.', *ASSET_SUFFIXES))}[page_id % 13 + 1])")
SQL["company_hosts"] = f"""SELECT page_id, host, {is_company('host')} AS is_company FROM (
  SELECT page_id, {_HOST} AS host FROM pages)"""

_KEYWORD_TABLE = r"""w AS (
  SELECT string_split(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS w FROM benchmark),
k AS (SELECT DISTINCT lower(trim(x)) AS keyword FROM (
  SELECT w[1] AS x FROM w UNION ALL SELECT concat_ws(' ', w[1], w[2]) FROM w) WHERE trim(x) <> '')"""
SQL["keyword_table_docs"] = "WITH " + _KEYWORD_TABLE + r""",
r AS (SELECT keyword, list_distinct(regexp_extract_all(keyword, '[\p{L}\p{N}]+')) AS runs FROM k),
d AS (SELECT doc_id, lower(text) AS t, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS runs
  FROM documents),
u AS (SELECT doc_id, unnest(runs) AS run FROM d),
m AS (SELECT doc_id, keyword, r.runs FROM u JOIN (SELECT keyword, runs, unnest(runs) AS run FROM r) r USING (run)
  GROUP BY doc_id, keyword, r.runs HAVING count(*) = len(r.runs))
SELECT doc_id, keyword FROM m WHERE keyword = runs[1]
UNION ALL SELECT m.doc_id, keyword FROM m JOIN d USING (doc_id) WHERE keyword <> m.runs[1]
  AND contains(t, keyword) AND regexp_matches(' ' || t || ' ',
    '[^\p{L}\p{N}]' || regexp_escape(keyword) || '[^\p{L}\p{N}]')"""
SQL["keyword_substring_docs"] = "WITH " + _KEYWORD_TABLE + """
SELECT doc_id, keyword FROM documents, k WHERE contains(lower(text), keyword)"""
SQL["denied_host_table"] = f"""WITH h AS (SELECT page_id, {host(authority('url'))} AS host FROM pages),
denied AS (SELECT host FROM h WHERE page_id % 7 = 0 UNION SELECT 'example.net')
SELECT page_id, host FROM h WHERE host NOT IN (SELECT host FROM denied)
  AND list_aggregate(list_slice(string_split(host, '.'), -2, -1), 'string_agg', '.') NOT IN (SELECT host FROM denied)"""

# --- queries and candidates -------------------------------------------------------------------


def plan(types) -> str:
    rows = ", ".join(
        f"({i}, {q(t)}, {j}, {q(tpl)})"
        for i, t in enumerate(types) for j, tpl in enumerate(QUERY_TEMPLATES[t]))
    return f"""WITH kw AS (SELECT keyword, row_number() OVER (ORDER BY ord) - 1 AS i,
    count(*) OVER () AS n FROM (SELECT p_name AS keyword, min(p_partkey) AS ord FROM part GROUP BY 1)),
  plan AS (SELECT type_ord, type, keyword, template, row_number() OVER (
    PARTITION BY type ORDER BY tpl_ord, i) - 1 AS turn
    FROM kw, (VALUES {rows}) v(type_ord, type, tpl_ord, template))
  SELECT turn * {len(types)} + type_ord AS q_ord, type, replace(template, '{{peptide}}', keyword) AS query
  FROM plan ORDER BY turn, type_ord"""


SQL["query_plan"] = plan(("manufacturing_lab", "research_only", "compounding_pharmacy"))
SQL["query_budget"] = plan(("research_only", "consumer_and_research")) + " LIMIT 40"
SQL["lookup_queries"] = (
    f"SELECT s_name AS name, replace({q(LOOKUP_QUERY)}, '%s', s_name) AS query FROM supplier")
SQL["provider_breaker"] = """SELECT provider, q_ord FROM (SELECT user_id AS provider,
  event_id AS q_ord, coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (
    PARTITION BY user_id ORDER BY event_id), 0) AS failures FROM events) WHERE failures = 0"""
SQL["query_caps"] = f"""SELECT provider, q_ord, position FROM (SELECT *,
  row_number() OVER (PARTITION BY provider, q_ord ORDER BY position) AS rn FROM (
  SELECT {array(PROVIDERS)}[user_id % 5 + 1] AS provider, user_id AS q_ord, event_id AS position
  FROM events)) WHERE rn <= CASE WHEN provider = 'brave' THEN 20 ELSE 40 END"""
_RESULTS = f"""responses AS (SELECT page_id AS q_ord, 'q' || (page_id % 7) AS query, url,
  {array(PROVIDERS[:4])}[page_id % 4 + 1] AS provider, page_id % 11 = 5 AS failed FROM pages),
results AS (SELECT provider, q_ord, query, position, failed,
  CASE position WHEN 0 THEN url ELSE split_part(url, '?', 1) END AS url,
  CASE position WHEN 0 THEN 't' || q_ord ELSE 'again' END AS title,
  CASE WHEN provider = 'serper' THEN '' WHEN position = 0 THEN 'about t' || q_ord
    ELSE 'about again' END AS snippet
  FROM responses, (VALUES (0), (1)) v(position))"""
SQL["search_results"] = with_(_RESULTS) + """SELECT provider, q_ord, query, position, url, title,
  snippet FROM results WHERE NOT failed"""
_PLACES = """places AS (SELECT 'p' || page_id AS place_id, 'google_places' AS provider,
  page_id AS q_ord, 'q' || (page_id % 7) AS query, position, 'Place ' || page_id AS name,
  CASE WHEN page_id % 2 = 0 THEN '1 Main St' END AS address, url
  FROM pages, (VALUES (0), (1)) v(position) WHERE contains(url, '.com'))"""
SQL["directory_websites"] = with_(_PLACES) + "SELECT * FROM places"
_UNION = f"""{_RESULTS}, {_PLACES},
first_failure AS (SELECT provider, min(q_ord) AS q FROM responses WHERE failed GROUP BY 1),
kept AS (SELECT r.provider, r.q_ord, r.query, r.position, r.url FROM results r
  LEFT JOIN first_failure f USING (provider)
  WHERE (f.q IS NULL OR r.q_ord < f.q) AND NOT failed AND r.provider IN ('bing', 'brave', 'serper')
  UNION ALL SELECT provider, q_ord, query, position, url FROM places),
cands AS (SELECT row_number() OVER (ORDER BY list_position({array(PROVIDERS)}, provider), q_ord, position,
  url, query) AS ord, url, query, provider AS source FROM kept)"""
SQL["candidate_union"] = with_(_UNION) + "SELECT * FROM cands"
SQL["first_candidates"] = with_(_UNION) + f"""SELECT ord, url, query, source, domain FROM (SELECT *,
  row_number() OVER (PARTITION BY domain ORDER BY ord) AS rn FROM (
  SELECT *, {domain('url')} AS domain FROM cands)) WHERE rn = 1 AND domain <> ''"""
SQL["visit_list"] = f"""SELECT page_id AS ord, url, 'q' || (page_id % 7) AS query, 'serper' AS source,
  domain FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY page_id) AS rn FROM (
  SELECT page_id, url, {domain('url')} AS domain FROM pages)) WHERE rn = 1 AND domain <> ''
  ORDER BY page_id LIMIT 25"""
SQL["lookup_provider"] = with_(_RESULTS) + """SELECT provider, q_ord, query, position, url, title
  FROM results WHERE NOT failed AND provider = 'brave'"""

# --- leads ------------------------------------------------------------------------------------

SQL["lead_outcomes"] = with_(_JUDGED) + "SELECT * FROM outcomes"
SQL["discovery_funnel"] = with_(_JUDGED) + funnel("outcomes", (
    "added", "duplicate", "skipped_not_relevant", "skipped_content_site", "skipped_not_a_vendor",
    "skipped_non_us", "fetch_failed"))
SQL["dry_run_preview"] = with_(_JUDGED) + """SELECT domain, company_type, sells_direct, manufactures,
  is_content_site, us_based, state, email FROM judged WHERE reason IS DISTINCT FROM 'fetch_failed'"""
SQL["lead_inserts"] = with_(_JUDGED) + f"""SELECT (SELECT max(id) FROM known) + row_number() OVER (
    ORDER BY ord) AS id, coalesce(nullif(company_name, ''), domain) AS company_name, url AS website,
  domain, email, phone, description, 'serper' AS source, query AS matched_query,
  research_only_evidence, company_type, sells_direct, manufactures, us_based, state, 'new' AS status,
  CAST(NULL AS TIMESTAMP) AS replied_at, false AS opted_out, CAST(NULL AS VARCHAR) AS notes,
  {TS_NOW} AS created_at, {TS_NOW} AS updated_at FROM judged ANTI JOIN known USING (domain)
  WHERE reason IS NULL"""

# --- roster -----------------------------------------------------------------------------------

SQL["roster_part"] = with_(ROSTER) + "SELECT * FROM roster WHERE country = 'United States'"
SQL["roster_head"] = with_(ROSTER) + """SELECT * FROM roster WHERE country = 'NATION_3'
  ORDER BY ord LIMIT 3"""
SQL["roster_located"] = with_(ROSTER) + "SELECT * FROM located"
SQL["missing_names"] = with_(ROSTER) + """SELECT * FROM roster WHERE name NOT IN (
  SELECT name FROM domain_map)"""
SQL["domain_map_merge"] = with_(ROSTER) + """SELECT name, country, CASE WHEN ord % 2 = 0
  THEN 'new' || ord || '.example.org' ELSE domain END AS domain FROM located
  WHERE domain IS NOT NULL OR ord % 2 = 0"""
_ROSTER_TABLE = f"""{ROSTER}, {LEADS},
listed AS (SELECT domain, arg_min(name, ord) AS name, arg_min(country, ord) AS country,
  min(ord) AS ord FROM located WHERE domain IS NOT NULL GROUP BY domain),
merged AS (SELECT l.* REPLACE (
    CASE WHEN s.domain IS NOT NULL AND NOT contains(l.source, 'vendor_roster')
      THEN l.source || '+vendor_roster' ELSE l.source END AS source,
    CASE WHEN s.domain IS NOT NULL AND NOT contains(l.source, 'vendor_roster')
      THEN {TS_NOW} ELSE l.updated_at END AS updated_at)
  FROM leads l LEFT JOIN listed s USING (domain)
  UNION ALL
  SELECT (SELECT max(id) FROM leads) + row_number() OVER (ORDER BY s.ord), s.name,
    'https://' || s.domain || '/', s.domain, NULL, NULL, NULL, 'vendor_roster', NULL, NULL, NULL,
    false, false, s.country = 'United States', NULL, 'new', NULL, false, NULL, {TS_NOW}, {TS_NOW}
  FROM listed s ANTI JOIN leads USING (domain))"""
SQL["roster_merge"] = with_(_ROSTER_TABLE) + "SELECT * FROM merged"


def enriched(source: str, only: str = "true") -> str:
    open_ = f"(coalesce(l.email, '') = '' AND f.n_pages > 0 AND {only})"

    def fill(c: str, value: str) -> str:
        return (f"CASE WHEN {open_} AND coalesce(l.{c}, '') = '' AND coalesce({value}, '') <> '' "
                f"THEN {value} ELSE l.{c} END AS {c}")
    return f"""SELECT l.* REPLACE ({fill('email', 'f.email')}, {fill('phone', 'f.phone')},
    {fill('company_type', "'research_only'")}, {fill('state', "'Texas'")},
    (l.sells_direct OR coalesce({open_}, false)) AS sells_direct,
    CASE WHEN {open_} AND (f.email IS NOT NULL OR l.phone IS NULL OR l.company_type IS NULL OR
      l.state IS NULL OR NOT l.sells_direct) THEN {TS_NOW} ELSE l.updated_at END AS updated_at)
  FROM {source} l LEFT JOIN found f USING (domain)"""


SQL["enriched_leads"] = with_(LEADS, ROSTER_PROFILES) + enriched("leads")
SQL["roster_merge_enriched"] = with_(_ROSTER_TABLE, ROSTER_PROFILES) + enriched(
    "merged", "l.domain IN (SELECT domain FROM listed)")
_ROSTER_OUT = f"""{ROSTER}, {LEADS}, {ROSTER_PROFILES},
rows_ AS (SELECT l.ord, l.name, l.domain, k.domain IS NULL AS fresh, nullif(k.email, '') AS email,
  f.email AS found_email, coalesce(f.n_pages, 0) AS n_pages,
  row_number() OVER (PARTITION BY l.domain ORDER BY l.ord) AS rn
  FROM located l LEFT JOIN leads k USING (domain) LEFT JOIN found f ON f.domain = l.domain),
outcomes AS (SELECT ord, name, domain, CASE WHEN domain IS NULL THEN 'no_domain'
    WHEN fresh AND rn = 1 THEN 'added' ELSE 'updated' END AS outcome,
  CASE WHEN domain IS NULL OR email IS NOT NULL THEN NULL
    WHEN found_email IS NOT NULL THEN CASE WHEN rn = 1 THEN 'enriched' END
    WHEN n_pages > 0 THEN 'reached' ELSE 'unreachable' END AS enrichment FROM rows_)"""
SQL["roster_outcomes"] = with_(_ROSTER_OUT) + "SELECT * FROM outcomes"
SQL["roster_funnel"] = with_(
    _ROSTER_OUT, """told AS (SELECT outcome FROM outcomes UNION ALL SELECT CASE enrichment
    WHEN 'reached' THEN 'unreachable' ELSE enrichment END FROM outcomes)"""
) + funnel("told", ("added", "updated", "no_domain", "enriched", "unreachable"))

# --- outreach ---------------------------------------------------------------------------------

_STEPS = f"""{LEADS}, {OUTREACH},
history AS (SELECT lead_id AS id, count(*) AS n_delivered, max(created_at) AS last_at FROM outreach
  WHERE delivery <> 'failed' GROUP BY 1),
steps AS (SELECT l.*, n_delivered, last_at, CASE
    WHEN replied_at IS NOT NULL OR opted_out OR status IN ('replied', 'qualified', 'disqualified')
      THEN NULL
    WHEN coalesce(n_delivered, 0) = 0 THEN 1
    WHEN n_delivered >= {FOLLOWUPS + 1} THEN NULL
    WHEN {TS_NOW} - last_at < INTERVAL 30 DAY THEN NULL ELSE n_delivered + 1 END AS next_step
  FROM leads l LEFT JOIN history USING (id)),
due AS (SELECT *, next_step AS step FROM steps WHERE next_step IS NOT NULL AND email <> '')"""
SQL["contactable_makers"] = with_(LEADS) + (
    "SELECT id, email FROM leads WHERE email IS NOT NULL AND email <> '' AND manufactures")
SQL["message_history"] = with_(_STEPS) + "SELECT id AS lead_id, n_delivered, last_at FROM history"
SQL["next_steps"] = with_(_STEPS) + """SELECT id, coalesce(n_delivered, 0) AS n_delivered, last_at,
  CAST(coalesce(next_step, 0) AS INTEGER) AS next_step FROM steps"""
SQL["due_plan"] = with_(_STEPS) + "SELECT id, email, step, created_at FROM due"
SQL["due_plan_capped"] = with_(_STEPS) + """SELECT id, email, step FROM due WHERE manufactures
  ORDER BY created_at, id LIMIT 10"""
_FIRST_BODY = FIRST[1].format(**SENDER)
_NEXT_BODY = FOLLOW_UP[1].format(**SENDER)
_RENDERED = f"""{_STEPS},
rendered AS (SELECT id, domain, created_at AS waiting_since, email AS to_email, step,
  CASE WHEN step = 1 THEN {q(FIRST[0])} ELSE {q(FOLLOW_UP[0])} END AS subject,
  CASE WHEN step = 1 THEN {q(_FIRST_BODY)} ELSE {q(_NEXT_BODY)} END AS body,
  CASE WHEN id % 6 = 0 THEN 'failed' ELSE 'drafted' END AS delivery FROM due)"""
SQL["draft_messages"] = with_(_RENDERED) + f"""SELECT id AS lead_id, step, to_email AS "to", subject,
  '"{SENDER['sender_name']}" <{SENDER['sender_email']}>' AS "from", {q(SENDER['sender_email'])} AS reply_to,
  body, printf('%04d-step%d-%s.eml', id, step, replace(domain, '.', '_')) AS draft FROM rendered"""
SQL["message_problems"] = with_(_RENDERED) + """SELECT id, CASE WHEN step = 1 THEN 'first'
  ELSE 'follow-up #' || (step - 1) END AS label, 'sender_postal_address' AS problems FROM rendered"""
SQL["outreach_log"] = with_(_RENDERED) + f"""SELECT (SELECT max(id) FROM outreach) + row_number() OVER (
    ORDER BY waiting_since NULLS FIRST, id) AS id, id AS lead_id, to_email, step, subject, body, delivery,
  CAST(NULL AS VARCHAR) AS error, {TS_NOW} AS created_at FROM rendered"""
SQL["contacted_leads"] = with_(_RENDERED) + f"""SELECT l.* REPLACE (
  CASE WHEN r.id IS NOT NULL THEN 'contacted' ELSE l.status END AS status,
  CASE WHEN r.id IS NOT NULL THEN {TS_NOW} ELSE l.updated_at END AS updated_at) FROM leads l
  LEFT JOIN (SELECT id FROM rendered WHERE delivery <> 'failed') r USING (id)"""
SQL["outreach_funnel"] = with_(_RENDERED, """told AS (
  SELECT 'prepared' AS outcome FROM rendered UNION ALL SELECT delivery FROM rendered UNION ALL
  SELECT CASE WHEN step = 1 THEN 'first_contact' ELSE 'followups' END FROM rendered
  WHERE delivery <> 'failed')""") + funnel(
    "told", ("prepared", "first_contact", "followups", "sent", "drafted", "failed"))
_RECEIPTS = f"""{_RENDERED.replace("CASE WHEN id % 6 = 0 THEN 'failed' ELSE 'drafted' END", "'planned'")},
receipts AS (
  SELECT id AS lead_id, step, CASE WHEN id % 6 = 0 THEN 'failed' ELSE 'sent' END AS delivery,
    {TS_NOW} + to_minutes(id % 7) AS delivered_at FROM rendered
  UNION ALL SELECT id, step, 'sent', {TS_NOW} + INTERVAL 60 MINUTE FROM rendered WHERE id % 12 = 0
  UNION ALL SELECT id + 10000000, step, CASE WHEN id % 6 = 0 THEN 'failed' ELSE 'sent' END,
    {TS_NOW} + to_minutes(id % 7) FROM rendered WHERE id % 17 = 0),
best AS (SELECT * FROM receipts QUALIFY row_number() OVER (
  PARTITION BY lead_id, step ORDER BY delivery DESC, delivered_at) = 1),
told AS (SELECT b.*, CASE WHEN EXISTS (SELECT 1 FROM outreach o WHERE o.lead_id = b.lead_id AND o.step = b.step
    AND (o.delivery <> 'failed' OR o.created_at = b.delivered_at)) THEN 'known'
  WHEN EXISTS (SELECT 1 FROM rendered r WHERE r.id = b.lead_id AND r.step = b.step) THEN 'logged'
  ELSE 'unplanned' END AS outcome FROM best b)"""
SQL["delivery_receipts"] = with_(_RECEIPTS) + """SELECT (SELECT max(id) FROM outreach) + row_number() OVER (
    ORDER BY t.delivered_at, r.waiting_since NULLS FIRST, t.lead_id, t.step) AS id, t.lead_id, r.to_email, t.step,
  r.subject, t.delivery, CASE WHEN t.delivery = 'failed' THEN 'refused' END AS error, t.delivered_at AS created_at
  FROM told t JOIN rendered r ON r.id = t.lead_id AND r.step = t.step WHERE outcome = 'logged'"""
SQL["receipt_outcomes"] = with_(_RECEIPTS) + "SELECT lead_id, step, delivery, outcome FROM told"
SQL["receipt_leads"] = with_(_RECEIPTS) + f"""SELECT l.id, CASE WHEN t.lead_id IS NOT NULL THEN 'contacted' ELSE l.status END AS status,
  CASE WHEN t.lead_id IS NOT NULL THEN {TS_NOW} ELSE l.updated_at END AS updated_at FROM leads l LEFT JOIN (
  SELECT DISTINCT lead_id FROM told WHERE outcome = 'logged' AND delivery <> 'failed') t ON t.lead_id = l.id"""
SQL["receipt_funnel"] = with_(_RECEIPTS, """counted AS (SELECT b.delivery, b.step FROM best b JOIN rendered r
  ON r.id = b.lead_id AND r.step = b.step),
outcomes AS (
  SELECT 'prepared' AS outcome FROM counted UNION ALL SELECT delivery FROM counted UNION ALL
  SELECT CASE WHEN step = 1 THEN 'first_contact' ELSE 'followups' END FROM counted
  WHERE delivery <> 'failed')""") + funnel(
    "outcomes", ("prepared", "first_contact", "followups", "sent", "drafted", "failed"))
SQL["due_counts"] = with_(_STEPS) + """SELECT count(next_step) AS due, count(*) AS contactable
  FROM steps WHERE email <> ''"""

# --- replies ----------------------------------------------------------------------------------

_OUT = q(rf"(?i)(^|{WORD})({RULES.opt_out_pattern})($|{WORD})")
_REPLIES = f"""{LEADS}, {OUTREACH}, {MESSAGES},
contacted AS (SELECT DISTINCT {mail_domain('to_email')} AS mail_domain, lead_id FROM outreach
  WHERE delivery <> 'failed' AND lead_id IN (SELECT id FROM leads)),
inbox AS (SELECT msg_id, {mail_domain('sender')} AS mail_domain, regexp_matches(body, {_OUT}) AS out
  FROM messages),
pairs AS (SELECT lead_id, msg_id, out, row_number() OVER (PARTITION BY lead_id ORDER BY msg_id) AS rn
  FROM contacted JOIN inbox USING (mail_domain)),
updates AS (SELECT lead_id, min(msg_id) AS first_msg_id, bool_or(out) AS any_out,
  bool_or(out) FILTER (WHERE rn = 1) AS first_out FROM pairs GROUP BY 1)"""
SQL["recent_messages"] = with_(MESSAGES) + f"""SELECT msg_id, received_at, sender, subject, body
  FROM messages WHERE CAST(received_at AS DATE) >= CAST({TS_NOW} AS DATE) - 30"""
SQL["contacted_map"] = with_(_REPLIES) + "SELECT * FROM contacted"
SQL["opt_out_messages"] = with_(MESSAGES) + f"""SELECT msg_id, sender,
  {mail_domain('sender')} || '>' AS raw_domain FROM messages WHERE regexp_matches(whole_body, {_OUT})"""
SQL["reply_updates"] = with_(_REPLIES) + (
    "SELECT lead_id, first_msg_id, any_out AS opted_out FROM updates")
SQL["reply_updates_first"] = with_(_REPLIES) + (
    "SELECT lead_id, first_msg_id, first_out AS opted_out FROM updates")
SQL["replied_leads"] = with_(_REPLIES) + f"""SELECT l.* REPLACE (
  CASE WHEN lead_id IS NULL THEN status ELSE 'replied' END AS status,
  CASE WHEN lead_id IS NULL THEN replied_at ELSE coalesce(replied_at, {TS_NOW}) END AS replied_at,
  (opted_out OR coalesce(any_out, false)) AS opted_out,
  CASE WHEN lead_id IS NOT NULL AND (replied_at IS NULL OR status <> 'replied' OR
    (any_out AND NOT opted_out)) THEN {TS_NOW} ELSE updated_at END AS updated_at)
  FROM leads l LEFT JOIN updates ON lead_id = id"""
SQL["unmatched_messages"] = with_(_REPLIES) + """SELECT mail_domain, count(*) AS n_messages FROM inbox
  WHERE mail_domain NOT IN (SELECT mail_domain FROM contacted) GROUP BY 1"""
SQL["reply_funnel"] = with_(_REPLIES, """told AS (
  SELECT CASE WHEN any_out THEN 'opt_outs' ELSE 'replies' END AS outcome FROM updates UNION ALL
  SELECT 'unmatched' FROM inbox WHERE mail_domain NOT IN (SELECT mail_domain FROM contacted))"""
) + funnel("told", ("replies", "opt_outs", "unmatched"))

# --- lead management --------------------------------------------------------------------------

_SHOWN = """SELECT id, company_name, website, domain, coalesce(nullif(email, ''), '—') AS email,
  replace(coalesce(company_type, '—'), '_', ' ') AS company_type, coalesce(state, '—') AS state,
  status, source, strftime(created_at, '%Y-%m-%d') AS added FROM leads"""
SQL["lead_list"] = with_(LEADS) + _SHOWN + (
    " WHERE status = 'contacted' AND company_type = 'research_only'")
SQL["lead_list_all"] = with_(LEADS) + _SHOWN
SQL["lead_by_id"] = with_(LEADS) + (
    "SELECT id, company_name, domain, status FROM leads WHERE id = 42")
SQL["lead_history"] = with_(LEADS, OUTREACH, """placed AS (SELECT *,
  (row_number() OVER (PARTITION BY lead_id ORDER BY id) - 1) >> 12 AS part FROM outreach)""") + """SELECT l.id,
  coalesce(o.part, 0) AS part, count(o.id) AS n,
  coalesce(string_agg(o.delivery || ' to ' || o.to_email || ' ' || strftime(o.created_at, '%Y-%m-%d'),
    '|' ORDER BY o.id), '') AS history FROM leads l LEFT JOIN placed o ON o.lead_id = l.id GROUP BY 1, 2"""
SQL["leads_after_delete"] = with_(LEADS) + """SELECT id, domain FROM leads WHERE id NOT IN (
  SELECT doc_id * 3 FROM labels)"""
SQL["outreach_after_delete"] = with_(OUTREACH) + """SELECT id, lead_id FROM outreach
  WHERE lead_id NOT IN (SELECT doc_id * 3 FROM labels)"""
_EDITS = """edits AS (SELECT doc_id AS ord, doc_id % 250 AS lead_id,
  CASE WHEN quality = 1 THEN 'replied' WHEN doc_id % 3 = 0 THEN 'qualified' END AS status,
  CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 5 = 1 THEN 'manufacturing_lab' END AS company_type,
  CASE WHEN doc_id % 2 = 0 THEN 'note ' || doc_id END AS notes, toxic = 1 AS opted_out FROM labels),
final AS (SELECT lead_id AS id, arg_max(status, ord) FILTER (WHERE status IS NOT NULL) AS status,
  arg_max(notes, ord) FILTER (WHERE notes IS NOT NULL) AS notes,
  nullif(arg_max(coalesce(company_type, ''), ord), '') AS company_type,
  arg_max(coalesce(opted_out, false), ord) AS opted_out,
  coalesce(bool_or(status = 'replied'), false) AS any_replied,
  arg_min(coalesce(status, ''), ord) = '' AS kept_first FROM edits GROUP BY 1),
edited AS (SELECT l.id, coalesce(f.status, l.status) AS status, coalesce(f.notes, l.notes) AS notes,
  CASE WHEN f.id IS NULL THEN l.company_type ELSE f.company_type END AS company_type,
  CASE WHEN f.id IS NULL THEN l.opted_out ELSE f.opted_out END AS opted_out,
  CASE WHEN f.any_replied OR (f.kept_first AND l.status = 'replied')
    THEN coalesce(l.replied_at, {now}) ELSE l.replied_at END AS replied_at
  FROM leads l LEFT JOIN final f USING (id))""".replace("{now}", TS_NOW)
SQL["edited_leads"] = with_(LEADS, _EDITS) + f"""SELECT l.* REPLACE (e.status AS status,
  e.notes AS notes, e.company_type AS company_type, e.opted_out AS opted_out, e.replied_at AS replied_at,
  CASE WHEN e.status IS DISTINCT FROM l.status OR e.notes IS DISTINCT FROM l.notes
    OR e.company_type IS DISTINCT FROM l.company_type OR e.opted_out IS DISTINCT FROM l.opted_out
    OR e.replied_at IS DISTINCT FROM l.replied_at THEN {TS_NOW} ELSE l.updated_at END AS updated_at)
  FROM leads l JOIN edited e USING (id)"""

# --- gates ------------------------------------------------------------------------------------

SQL["robots_verdicts"] = f"""WITH asked AS (SELECT page_id, {domain('url')} AS domain,
    {path('url')} AS path FROM pages),
  rules AS (SELECT domain, page_id AS ord, CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN '/en'
    WHEN 2 THEN '*' WHEN 3 THEN '/de' ELSE path END AS prefix, page_id % 3 = 0 AS allow FROM asked
    WHERE page_id % 4 <> 0),
  verdicts AS (SELECT a.page_id, arg_min(r.allow OR r.prefix = '', r.ord) AS allow FROM asked a
    JOIN rules r ON a.domain = r.domain AND (r.prefix = '*' OR starts_with(a.path, r.prefix))
    GROUP BY 1)
  SELECT page_id, domain, path, coalesce(allow, true) AND NOT starts_with(domain, 'blog.ththo')
    AS allowed FROM asked LEFT JOIN verdicts USING (page_id)"""
_PUBLIC = f"""ips AS (SELECT {domain('url')} AS domain, ['8', '93', '10', '172', '192', '100', '11',
    '198'][page_id % 97 % 8 + 1]::INT AS a, page_id % 200 AS b, page_id % 7 AS c FROM pages),
public AS (SELECT domain FROM ips GROUP BY 1 HAVING bool_and(NOT (a = 10
  OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 192 AND b = 0 AND c = 2)
  OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 198 AND b BETWEEN 18 AND 19))
  ))"""
SQL["public_domains"] = with_(_PUBLIC) + "SELECT domain FROM public"
SQL["public_pages"] = with_(_PUBLIC) + f"""SELECT page_id, {domain('url')} AS domain FROM pages
  WHERE {domain('url')} IN (SELECT domain FROM public)"""

# --- lists ------------------------------------------------------------------------------------

SQL["keyword_lines"] = f"""SELECT doc_id, pos, md5({strip('value')}) AS keyword_md5
  FROM (SELECT doc_id, pos, CASE WHEN pos % 9 = 4 THEN '#' || line WHEN pos % 9 = 5
    THEN '  # ' || line ELSE line END AS value FROM (SELECT doc_id, i - 1 AS pos, l[i] AS line FROM (
    SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (
    SELECT doc_id, str_split(text, chr(10)) AS l FROM documents))))
  WHERE NOT starts_with(value, '#') AND {strip('value')} <> ''"""
SQL["roster_lines"] = with_(ROSTER) + """SELECT ord, name, CASE WHEN ord % 7 = 1 THEN ''
  ELSE country END AS country FROM roster WHERE ord % 7 <> 0"""
SQL["domain_map_lines"] = with_(ROSTER) + """SELECT max(ord) AS line_no, country AS name,
  arg_max(name, ord) AS country, 'd' || max(ord) || '.net' AS domain FROM roster WHERE ord % 7 <> 0
  GROUP BY 2"""
SQL["message_templates"] = f"""SELECT doc_id,
  md5({strip("'a: ' || split_part(text, chr(10), 1)")}) AS subject_md5,
  md5(ltrim(array_to_string(list_slice(CASE WHEN l[-1] = '' THEN list_slice(l, 1, -2) ELSE l END,
    2, -1), chr(10)), chr(10))) AS body_md5
  FROM (SELECT doc_id, text, str_split(text, chr(10)) AS l FROM documents)"""

# --- plans and streams ------------------------------------------------------------------------

_BLOCKED = f"""blocked AS (SELECT {domain('url')} AS domain, {path('url')} AS prefix, page_id AS ord
  FROM pages WHERE page_id % 3 = 0),
known AS (SELECT {domain('url')} AS domain FROM pages WHERE ends_with({domain('url')}, '.org') GROUP BY 1),
open_pages AS (SELECT * FROM pages p WHERE NOT EXISTS (SELECT 1 FROM blocked b
    WHERE b.domain = {domain('p.url')} AND starts_with({path('p.url')}, b.prefix))
  AND {domain('url')} IN (SELECT domain FROM public)
  AND {domain('url')} NOT IN (SELECT domain FROM known))"""
SQL["discovery_run"] = with_(
    _PUBLIC, _BLOCKED, _FEATURES.replace("FROM pages WHERE", "FROM open_pages WHERE"), profiles(),
    f"""visits AS (SELECT {domain('url')} AS domain, min(page_id) AS ord FROM pages
  WHERE {domain('url')} <> '' GROUP BY 1)""",
) + f"""SELECT v.ord, v.domain, CASE WHEN k.domain IS NOT NULL THEN 'duplicate'
    WHEN p.domain IS NULL THEN 'fetch_failed' ELSE coalesce({_REASON.format(us='')}, 'added') END AS outcome
  FROM visits v LEFT JOIN profiles p USING (domain) LEFT JOIN known k ON k.domain = v.domain"""
_TICK = _RENDERED.replace("CASE WHEN id % 6 = 0 THEN 'failed' ELSE 'drafted' END", "'drafted'")
_LOG = f"""SELECT (SELECT max(id) FROM outreach) + row_number() OVER (
  ORDER BY waiting_since NULLS FIRST, id) AS id, id AS lead_id,
  to_email, step, subject, body, delivery, CAST(NULL AS VARCHAR) AS error, {TS_NOW} AS created_at
  FROM rendered"""
SQL["cadence_tick"] = with_(_TICK) + f"SELECT * FROM outreach UNION ALL {_LOG}"
SQL["cadence_run"] = with_(
    _TICK, MESSAGES, f"""answered AS (SELECT DISTINCT lead_id FROM outreach o JOIN messages m
    ON {mail_domain('o.to_email')} = {mail_domain('m.sender')} WHERE delivery <> 'failed'
    AND CAST(received_at AS DATE) >= CAST({TS_NOW} AS DATE) - 20)""",
) + _LOG + " WHERE id NOT IN (SELECT lead_id FROM answered)"
SQL["roster_run"] = SQL["roster_funnel"].replace(
    "FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'NATION_7'")
SQL["discovery_stream"] = (
    SQL["lead_inserts"].replace("(SELECT max(id) FROM known) + ", "")
    .replace("ANTI JOIN known USING (domain)", "").replace("'serper' AS source", "'page_stream' AS source")
    .replace("query AS matched_query", "'stored pages' AS matched_query"))
SQL["reply_stream"] = SQL["replied_leads"]

# --- name similarity: longest common blocks, found again left and right of each ---------------


def block(a: str, b: str) -> str:
    """The longest common block of two strings as {k, i, j}: longest, then earliest in a, then b;
    i and j negated."""
    common = (f"len(list_filter(range(1, least(length({a}) - i, length({b}) - j) + 1), "
              f"lambda k: substr({a}, i + 1, k) = substr({b}, j + 1, k)))")
    return (f"list_reverse_sort(flatten(list_transform(range(length({a})), lambda i: list_transform("
            f"range(length({b})), lambda j: {{'k': {common}, 'i': -i, 'j': -j}}))))[1]")


def slug(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^a-z0-9]', '', 'g')"


def first_letter_up(x: str) -> str:
    return f"upper({x}[1]) || lower(substr({x}, 2))"


_LABEL = f"regexp_extract({domain('url')}, '([a-z\\-]+)\\.example', 1)"
_LOOKUP_HOST = host("split_part(regexp_replace(url, '^https?://', ''), '/', 1)")
_SCORES = f"""lookups AS (SELECT n.name, n.position, p.url FROM (
  SELECT {first_letter_up(_LABEL)} || ' Inc.' AS name, page_id % 7 AS position,
    page_id + page_id % 3 AS other FROM pages) n JOIN pages p ON p.page_id = n.other),
found AS (SELECT name, host, min(position) AS position FROM (
  SELECT name, position, {_LOOKUP_HOST} AS host FROM lookups)
  WHERE {is_company('host')} AND host NOT IN {many(RULES.never_official_hosts)} GROUP BY 1, 2),
pairs AS (SELECT name, host, position, {slug('name')} AS a, {slug("split_part(host, '.', 1)")} AS b
  FROM found),
parts AS (SELECT name, host, a, b FROM pairs UNION ALL
  SELECT name, host, c.a, c.b FROM (SELECT name, host, unnest([
      {{'a': left(a, -m.i), 'b': left(b, -m.j)}},
      {{'a': substr(a, m.k - m.i + 1), 'b': substr(b, m.k - m.j + 1)}}]) AS c
    FROM (SELECT *, {block('a', 'b')} AS m FROM parts WHERE a <> '' AND b <> '') WHERE m.k > 0)
  WHERE c.a <> '' AND c.b <> ''),
matched AS (SELECT name, host, sum(({block('a', 'b')}).k)::DOUBLE AS n FROM parts
  WHERE a <> '' AND b <> '' GROUP BY 1, 2),
ratios AS (SELECT p.name, p.host, p.position, CASE WHEN length(a) + length(b) = 0 THEN 1.0::DOUBLE
  ELSE 2.0::DOUBLE * coalesce(n, 0.0::DOUBLE) / (length(a) + length(b)) END AS similarity
  FROM pairs p LEFT JOIN matched USING (name, host)),
scores AS (SELECT *, similarity + greatest(0.0::DOUBLE, (5 - position)::DOUBLE) * 0.01::DOUBLE AS score
  FROM ratios),
official AS (SELECT name, host AS domain, score FROM (SELECT *, row_number() OVER (PARTITION BY name
  ORDER BY score DESC, position, host DESC) AS rn FROM scores) WHERE rn = 1 AND score >= 0.55::DOUBLE AND score > 0)"""


def recursive(*ctes: str) -> str:
    return with_(*ctes).replace("WITH", "WITH RECURSIVE", 1)


SQL["host_scores"] = recursive(_SCORES) + "SELECT name, host, position, similarity, score FROM scores"
SQL["official_domains"] = recursive(_SCORES) + "SELECT name, domain, score FROM official"
_NAMES = "names AS (SELECT DISTINCT name FROM lookups)"
SQL["resolution_totals"] = recursive(_SCORES, _NAMES) + """SELECT count(o.name) AS resolved,
  count_if(o.name IS NULL)::BIGINT AS unresolved FROM names LEFT JOIN official o USING (name)"""
SQL["unresolved_names"] = recursive(_SCORES, _NAMES) + """SELECT name FROM names
  WHERE name NOT IN (SELECT name FROM official)"""

# --- resolve-only runs, stored tables ---------------------------------------------------------

SQL["resolve_map"] = recursive(_SCORES, ROSTER) + """SELECT name, 'US' AS country, domain FROM official
  UNION ALL SELECT name, country, domain FROM domain_map"""
_NEW_SEEDS = f"""seeds AS (SELECT DISTINCT {host(authority('url'))} AS host FROM pages WHERE contains(url, '.org')),
resolved AS (SELECT DISTINCT domain AS host FROM official)"""
SQL["resolve_seeds"] = recursive(_SCORES, _NEW_SEEDS) + """SELECT host, 'https://' || host || '/' AS url
  FROM resolved ANTI JOIN seeds USING (host)"""
SQL["resolve_totals"] = recursive(_SCORES, _NAMES, _NEW_SEEDS) + """SELECT
  (SELECT count(*) FROM official) AS resolved,
  (SELECT count(*) FROM names WHERE name NOT IN (SELECT name FROM official)) AS unresolved,
  (SELECT count(*) FROM resolved WHERE host NOT IN (SELECT host FROM seeds)) AS added,
  (SELECT count(*) FROM resolved WHERE host IN (SELECT host FROM seeds)) AS known"""
SQL["unresolved_sample"] = recursive(_SCORES, _NAMES) + """SELECT ord, name FROM (
  SELECT name, row_number() OVER (ORDER BY name) AS ord FROM names)
  WHERE name NOT IN (SELECT name FROM official) ORDER BY ord LIMIT 20"""
SQL["lead_table"] = with_(LEADS) + "SELECT id, domain, email, status, source, created_at FROM leads"
SQL["outreach_table"] = with_(OUTREACH) + """SELECT id, lead_id, to_email, step, subject, delivery, error,
  created_at FROM outreach"""
SQL["cadence_leads"] = with_(_RENDERED.replace("CASE WHEN id % 6 = 0 THEN 'failed' ELSE 'drafted' END", "'drafted'")) + f"""
SELECT l.id, CASE WHEN r.id IS NOT NULL THEN 'contacted' ELSE l.status END AS status,
  CASE WHEN r.id IS NOT NULL THEN {TS_NOW} ELSE l.updated_at END AS updated_at
  FROM leads l LEFT JOIN rendered r ON r.id = l.id"""
_PAGE_DOMAIN = domain("url")
SQL["discovery_new_leads"] = f"""SELECT (SELECT coalesce(max(i), 0) FROM (SELECT min(page_id) AS i FROM pages
    WHERE {_PAGE_DOMAIN} LIKE '%.org' GROUP BY {_PAGE_DOMAIN})) + row_number() OVER (ORDER BY ord) AS id, domain
  FROM ({SQL['discovery_run']}) WHERE outcome = 'added'"""
