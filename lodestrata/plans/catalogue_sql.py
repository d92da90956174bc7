"""The registered queries in DuckDB's SQL, over the same whole tables."""

from __future__ import annotations

from lodestrata.functions.paths import LANGUAGES
from lodestrata.plans.golden import SETS, values

# Heads of declarations on one line, for both engines.
_E = r"^(?:export[ \t]+)?"
CLASS_HEAD = _E + r"(?:abstract[ \t]+)?class[ \t]+(\w+)"
INTERFACE_HEAD = _E + r"interface[ \t]+(\w+)"
ENUM_HEAD = _E + r"(?:const[ \t]+)?enum[ \t]+(\w+)"
TYPE_HEAD = _E + r"type[ \t]+(\w+)[^=]*="
FUNCTION_HEAD = _E + r"(?:async[ \t]+)?function[ \t]+(\w+)"
ARROW_HEAD = _E + r"(?:const|let|var)[ \t]+(\w+)[^=]*=[ \t]*(?:async[ \t]+)?(?:\([^)]*\)|[^=])[ \t]*=>"
DEFAULT_HEAD = r"^export[ \t]+default[ \t]+(?:async[ \t]+)?(?:function|class)[ \t]+(\w+)"
HEADS = [("class", CLASS_HEAD), ("interface", INTERFACE_HEAD), ("enum", ENUM_HEAD), ("type", TYPE_HEAD), ("function", FUNCTION_HEAD), ("arrow_function", ARROW_HEAD), ("export_default", DEFAULT_HEAD)]

NORMAL = r"regexp_replace(regexp_replace(regexp_replace(replace(file_path, '\', '/'), '/+', '/', 'g'), '(^|/)(\./)+', '\1', 'g'), '^/|/$', '', 'g')"
BASE = "regexp_extract(file_path, '[^/]*$')"
EXT = rf"lower(regexp_extract({BASE}, '(\.[^.]*)$', 1))"
LANG = f"case {EXT} " + " ".join(f"when '.{k}' then '{v}'" for k, v in LANGUAGES.items()) + " else 'text' end"
MODULE = "case when instr(file_path, '/') = 0 then '' else string_split(file_path, '/')[-2] end"
STRATEGY = f"case when {EXT} = '.go' then 'go' when {EXT} in ('.ts', '.tsx', '.js', '.jsx', '.vue') then 'typescript' when {EXT} = '.php' then 'php' when {EXT} in ('.md', '.markdown') then 'markdown' else 'fixed' end"
F_ = f"f0 as (select project_id, {NORMAL} as file_path, text from documents where text is not null and project_id is not null and file_path is not null), f as (select *, {LANG} as language, {MODULE} as module, row_number() over () as fid from f0)"


def chunk_id(project: str, path: str, symbol: str, hashed: str) -> str:
    return f"concat_ws(':', {project}, {path}, replace(case when coalesce({symbol}, '') = '' then '_' else {symbol} end, ':', '_'), substr({hashed}, 1, 8))"


def chunk_out(source: str, kind: str, language: str = "language") -> str:
    """From rows with project_id, file_path, language, module, symbol, start_line, end_line, content to chunks."""
    return f"""select project_id, file_path, symbol, {kind} as symbol_type, {language} as language, module, start_line::int as start_line, end_line::int as end_line, (strlen(content) // 4)::int as token_count,
      sha256(content) as content_hash, {chunk_id('project_id', 'file_path', 'symbol', 'sha256(content)')} as chunk_id from {source}"""


WHOLE = f"(select project_id, file_path, language, module, {BASE} as symbol, 1 as start_line, len(string_split(text, chr(10))) as end_line, text as content from f where strlen(text) // 4 <= 800)"
LATER = rf"replace(regexp_replace({BASE}, '\.[^.]*$', ''), '.', '_')"
PACKED = f"""l as (select fid, project_id, file_path, language, module, string_split(text, chr(10)) as a from f where strlen(text) // 4 > 800),
 r as (select fid, 1 as n, 1 as s, strlen(a[1]) // 4 as t from l
   union all select r.fid, n + 1, case when t + strlen(l.a[n + 1]) // 4 > 800 then n + 1 else s end, case when t + strlen(l.a[n + 1]) // 4 > 800 then strlen(l.a[n + 1]) // 4 else t + strlen(l.a[n + 1]) // 4 end from r join l on l.fid = r.fid where n < len(l.a)),
 g as (select fid, s, max(n) as e from r group by fid, s),
 packed as (select project_id, file_path, language, module, case when s > 1 then {LATER} else {BASE} end as symbol, s as start_line, e as end_line, array_to_string(a[s:e], chr(10)) as content from g join l using (fid))"""

HEADING = r"^(#{1,6})[\t\n\f\r ]+(.+)$"
SECTIONS = f"""m as (select * from f where {STRATEGY} = 'markdown'),
 ln as (select fid, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from m),
 hd as (select *, sum(case when regexp_matches(line, '{HEADING}') or n = 1 then 1 else 0 end) over (partition by fid order by n) as sec from ln),
 sections as (select fid, sec::int as sec, min(n) as start_line, max(n) as end_line, string_agg(line, chr(10) order by n) as content, arg_min(line, n) as head from hd group by fid, sec),
 named as (select *, case when regexp_matches(head, '{HEADING}') then regexp_extract(head, '{HEADING}', 2) else '(intro)' end as symbol from sections)"""
# s: section; runs carry (start, end, anchor, bytes); `held` is a first run that waits
MERGED = """sz as (select fid, sec, strlen(content) as b, count(*) over (partition by fid) as total from named),
 fold as (select fid, sec, total,
     case when b // 4 < 200 and sec < total then 0 else 1 end as runs, case when b // 4 < 200 and sec < total then 0 else 1 end as run_id,
     case when b // 4 < 200 and sec < total then 0 else b end as bytes, case when b // 4 < 200 and sec < total then b else -1 end as held, true as pushed
   from sz where sec = 1
   union all
   select s.fid, s.sec, s.total,
     case when o.small and fold.runs > 0 then fold.runs when o.small and s.sec < s.total then fold.runs else fold.runs + 1 end,
     case when o.small and fold.runs > 0 then fold.runs when o.small and s.sec < s.total then fold.runs else fold.runs + 1 end,
     case when o.small and fold.runs > 0 then fold.bytes + 2 + o.own when o.small and s.sec < s.total then fold.bytes else o.own end,
     case when o.small and fold.runs = 0 and s.sec < s.total then o.own else -1 end,
     not (o.small and fold.runs > 0)
   from fold join sz s on s.fid = fold.fid and s.sec = fold.sec + 1, lateral (select case when fold.held >= 0 then fold.held + 2 + s.b else s.b end as own, (case when fold.held >= 0 then fold.held + 2 + s.b else s.b end) // 4 < 200 as small) o),
 placed as (select fid, sec, greatest(run_id, 1) as run_id, case when run_id >= 1 and pushed then sec end as anchor from fold),
 runs as (select p.fid, p.run_id, min(n.start_line) as start_line, max(n.end_line) as end_line, string_agg(n.content, chr(10) || chr(10) order by p.sec) as content, max(p.anchor) as anchor
   from placed p join named n on n.fid = p.fid and n.sec = p.sec group by p.fid, p.run_id)"""

# manifest
LATEST = """mm as (select * from (select *, row_number() over (partition by project_id, file_path order by coalesce(indexed_at, '1970-01-01'::timestamptz) desc, coalesce(file_hash, '') desc, coalesce(array_to_string(chunk_ids, ','), '') desc, (chunk_hashes is not null) desc, coalesce(mod_time, '1970-01-01'::timestamptz) desc) as rn from manifest) where rn = 1)"""
ENTRIES = LATEST + """, e0 as (select project_id, file_path, chunk_hashes, unnest(list_distinct(list_concat(coalesce(chunk_ids, []), coalesce(map_keys(chunk_hashes), [])))) as chunk_id from mm),
 entries as (select project_id, file_path, chunk_id, chunk_hashes[chunk_id] as chunk_hash from e0)"""
P_FILES = f"pf as (select project_id, {NORMAL} as file_path, max(sha256(content)) as file_hash from points where symbol_type = 'file' and content is not null and project_id is not null and file_path is not null group by all)"
SCANNED = f"sc as (select distinct project_id, {NORMAL} as file_path from points where project_id is not null and file_path is not null)"
P_CHUNKS = f"pc as (select project_id, {NORMAL} as file_path, chunk_id, max(content_hash) as content_hash, min(coalesce(start_line, 0)) as position from points where chunk_id is not null and content_hash is not null and project_id is not null and file_path is not null group by all)"
SAME = "x.project_id is not distinct from y.project_id and x.file_path is not distinct from y.file_path"
CHANGED_F = f"select x.project_id, x.file_path, x.file_hash from pf x where not exists (select 1 from mm y where {SAME} and x.file_hash is not distinct from y.file_hash)"
SKIPPED_F = f"select x.project_id, x.file_path, x.file_hash from pf x where exists (select 1 from mm y where {SAME} and x.file_hash is not distinct from y.file_hash)"
DELETED_F = f"select x.project_id, x.file_path from mm x where not exists (select 1 from sc y where {SAME})"
CHANGED_C = f"select x.project_id, x.file_path, x.chunk_id, x.content_hash from pc x where not exists (select 1 from entries y where {SAME} and x.chunk_id = y.chunk_id and x.content_hash is not distinct from y.chunk_hash)"
STALE_C = f"select distinct x.project_id, x.file_path, x.chunk_id from entries x where exists (select 1 from pc y where {SAME}) and not exists (select 1 from pc y where {SAME} and x.chunk_id = y.chunk_id)"

# points
ONE = "row_number() over (partition by point_id order by indexed_at desc nulls last, coalesce(start_line, 0) asc, coalesce(file_path, '') desc) = 1"
EXISTING = f"ex as (select * from points where indexed_at < '2025-11-15 00:00:00+00'::timestamptz qualify {ONE})"
STORE_OUT = "point_id, start_line, content_hash"
COSINE = "list_cosine_similarity(p.vector::double[], q.vector::double[])"
USABLE = "len(vector) = 48 and isfinite(list_inner_product(vector::double[], vector::double[])) and list_inner_product(vector::double[], vector::double[]) > 0"
QUERY = "q as (select vector from search_query where query_id = 3)"


def topk(where: str, k: int, least: str = "true") -> str:
    return f"""with {QUERY}, p as (select * from points where {USABLE} and {where} qualify {ONE})
      select point_id, project_id, symbol, round(s, 6) as score from (select p.*, {COSINE} as s from p, q) where {least} order by s desc, point_id limit {k}"""


BATCH = f"""q as (select query_id, vector, least(20, case when coalesce(top_k, 0) <= 0 then 5 else top_k end) as k, case when isnan(score_threshold) then null else score_threshold::double end as t, nullif(project_id, '') as fp, nullif(module, '') as fm, nullif(language, '') as fl, nullif(symbol_type, '') as fs from search_query where {USABLE}),
 p as (select point_id, project_id, module, language, symbol_type, vector from points where {USABLE} qualify row_number() over (partition by point_id) = 1),
 s as (select query_id, k, point_id, {COSINE} as s, t from p join q on (fp is null or fp = project_id) and (fm is null or fm = module) and (fl is null or fl = language) and (fs is null or fs = symbol_type)),
 b as (select query_id, k, point_id, s, row_number() over (partition by query_id order by s desc, point_id) as rank from s where t is null or t = 0 or s >= t),
 best as (select query_id, rank::int as rank, point_id, s as score from b where rank <= k)"""
PAYLOAD = f"pay as (select point_id, file_path, content, symbol, symbol_type, project_id, module, language, start_line, end_line from points qualify {ONE})"
PROJECTED = "pr as (select b.query_id, b.rank, b.point_id, file_path as source, content, nullif(symbol, '') as symbol, nullif(symbol_type, '') as symbol_type, project_id, nullif(module, '') as module, nullif(language, '') as language, nullif(start_line, 0) as start_line, nullif(end_line, 0) as end_line, round(b.score, 6) as score from best b join pay using (point_id))"
UNIQUE = f"u as (select * from points where content is not null qualify {ONE})"
OVERSIZED = "ov as (select project_id, file_path, symbol, (2 * strlen(content) // 5)::int as token_count, 2048 as max_allowed, strlen(content)::int as content_size_bytes from u where 2 * strlen(content) // 5 > 2048)"
COUNTERS = f"""c as ({' union all '.join(f"select project_id, '{n}' as what from ({q})" for n, q in (('files_scanned', 'select * from pf'), ('files_indexed', CHANGED_F), ('files_skipped', SKIPPED_F), ('files_deleted', DELETED_F), ('chunks_created', CHANGED_C), ('chunks_deleted', STALE_C), ('oversized', 'select * from ov where project_id is not null')))}),
 s as (select project_id, {', '.join(f"count(*) filter (what = '{n}') as {n}" for n in ('files_scanned', 'files_indexed', 'files_skipped', 'files_deleted', 'chunks_created', 'chunks_deleted', 'oversized'))} from c group by project_id)"""
COUNTER_CTES = ", ".join([ENTRIES, P_FILES, SCANNED, P_CHUNKS, UNIQUE, OVERSIZED, COUNTERS])
SUMS = ", ".join(f"sum({n})::bigint as {n}" for n in ("files_scanned", "files_indexed", "files_skipped", "files_deleted", "chunks_created", "chunks_deleted", "oversized"))
GLOB = "starts_with(a, x) or regexp_extract(a, '[^/]*$') glob x or (ends_with(x, '/') and contains(a, x))"

CUTOFF, EARLY = "'2025-11-15 00:00:00+00'::timestamptz", "'2025-07-01 00:00:00+00'::timestamptz"
D_FILES = f"select project_id, {NORMAL} as file_path, max(sha256(text)) as h from documents where text is not null and project_id is not null and file_path is not null"
JOB = f"""with a as ({D_FILES} and indexed_at < {CUTOFF} group by all), b as ({D_FILES} and coalesce(indexed_at >= {EARLY}, true) group by all),
 j as (select coalesce(a.project_id, b.project_id) as project_id, a.h as ah, b.h as bh from a full join b on a.project_id = b.project_id and a.file_path = b.file_path),
 n as (select project_id, count(bh) as files_scanned, count(*) filter (ah = bh) as files_skipped, count(*) filter (bh is null) as files_deleted from j group by project_id)"""

SQL: dict[str, str] = {
    "scan_files": f"with {F_} select project_id, file_path, strlen(text)::int as n_bytes from f",
    "filter_include_ext": f"with {F_} select f.project_id, f.file_path from f join project_config c using (project_id) where list_contains(list_transform(c.include_extensions, lambda x: lower(x)), {EXT})",
    "filter_exclude_path": f"""with {SCANNED}, t as (select s.project_id, s.file_path, c.exclude_paths, unnest(list_concat(['.'], list_transform(range(1, len(string_split(file_path, '/')) + 1), lambda i: array_to_string(string_split(file_path, '/')[1:i], '/')))) as a from sc s join project_config c using (project_id)),
      v as (select project_id, file_path, a, unnest(exclude_paths) as x from t) select distinct project_id, file_path from v where {GLOB}""",
    "detect_language": f"with {F_} select project_id, file_path, language from f",
    "extract_module": f"with {F_} select project_id, file_path, module from f",
    "file_hash": f"with {F_} select project_id, file_path, sha256(text) as file_hash from f",
    "chunk_id": f"select distinct point_id, {chunk_id('project_id', NORMAL, 'symbol', 'content_hash')} as made_id from points",
    "point_id": "select distinct chunk_id, concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), substr(h, 13, 4), substr(h, 17, 4), substr(h, 21, 12)) as made_id from (select chunk_id, sha256(chunk_id) as h from points where chunk_id is not null)",
    "token_estimates": "select distinct point_id, (strlen(content) // 4)::int as index_tokens, (2 * strlen(content) // 5)::int as report_tokens from points where content is not null",
    "effective_chunking": "select project_id, case when min_tokens > 0 then min_tokens else 200 end as min_tokens, case when ideal_tokens > 0 then ideal_tokens else 500 end as ideal_tokens, case when max_tokens > 0 then max_tokens else 800 end as max_tokens from project_config",
    "topk_clamp": "select query_id, least(20, case when coalesce(top_k, 0) <= 0 then 5 else top_k end) as k from search_query",
    "chunk_whole_file": f"with {F_} {chunk_out(WHOLE, chr(39) + 'file' + chr(39))}",
    "chunk_fixed": f"with recursive {F_}, {PACKED} {chunk_out(WHOLE, chr(39) + 'file' + chr(39))} union all {chunk_out('packed', chr(39) + 'fragment' + chr(39))}",
    "chunk_dispatch": f"with {F_} select project_id, file_path, {STRATEGY} as strategy from f",
    "chunk_markdown_sections": f"with {F_}, {SECTIONS}, o as (select project_id, file_path, module, symbol, start_line, end_line, content from named join m using (fid)) {chunk_out('o', chr(39) + 'heading' + chr(39), chr(39) + 'markdown' + chr(39))}",
    "chunk_markdown_merged": f"with recursive {F_}, {SECTIONS}, {MERGED}, o as (select project_id, file_path, module, n.symbol, r.start_line, r.end_line, r.content from runs r join named n on n.fid = r.fid and n.sec = r.anchor join m on m.fid = r.fid) {chunk_out('o', chr(39) + 'heading' + chr(39), chr(39) + 'markdown' + chr(39))}",
    "symbol_dedupe_priority": f"""with t as (select project_id, {NORMAL} as file_path, content from points where symbol_type = 'file' and content is not null and project_id is not null and file_path is not null qualify row_number() over (partition by point_id order by file_path) = 1),
      ln as (select project_id, file_path, unnest(string_split(content, chr(10))) as line, generate_subscripts(string_split(content, chr(10)), 1) as n from t where {STRATEGY} = 'typescript'),
      k as ({' union all '.join(f"select project_id, file_path, n::int as line_no, {i} as pr, '{k}' as symbol_type, regexp_extract(line, '{p}', 1) as symbol from ln where regexp_matches(line, '{p}')" for i, (k, p) in enumerate(HEADS))})
      select project_id, file_path, line_no, symbol_type, symbol from k where symbol <> '' qualify row_number() over (partition by project_id, file_path, line_no order by pr) = 1""",
    "diff_changed_files": f"with {LATEST.replace('from manifest)', f'from manifest where indexed_at < {CUTOFF})')}, {P_FILES} {CHANGED_F}",
    "index_incremental": f"{JOB} select project_id, files_scanned, files_scanned - files_skipped as files_indexed, files_skipped, files_deleted, 0::bigint as apart from n where files_scanned > 0",
    "index_full": f"{JOB} select project_id, files_scanned, files_scanned as files_indexed, 0::bigint as files_skipped, files_deleted, 0::bigint as apart from n where files_scanned > 0",
    "chunk_integrity": f"with t as (select project_id, {NORMAL} as file_path from points where symbol_type = 'file' and content is not null and project_id is not null and file_path is not null qualify row_number() over (partition by point_id order by file_path) = 1), k as (select *, {STRATEGY} as strategy from t) select strategy, count(distinct (project_id, file_path)) as files, 0::bigint as wrong_content, 0::bigint as wrong_hash, 0::bigint as wrong_id from k where strategy in ('go', 'typescript', 'php') group by strategy",
    **{f"chunk_golden_{kind}": values(kind) for kind in SETS},
    "diff_skipped_files": f"with {LATEST}, {P_FILES} {SKIPPED_F}",
    "diff_deleted_files": f"with {LATEST}, {SCANNED} {DELETED_F}",
    "purge_deleted_chunks": f"with {ENTRIES}, {SCANNED}, d as ({DELETED_F}) select distinct x.project_id, x.file_path, x.chunk_id from entries x where exists (select 1 from d y where {SAME})",
    "diff_changed_chunks": f"with {ENTRIES}, {P_CHUNKS} {CHANGED_C}",
    "diff_stale_chunks": f"with {ENTRIES}, {P_CHUNKS} {STALE_C}",
    "manifest_upsert": f"""with {LATEST}, {P_FILES}, {P_CHUNKS},
      new as (select pf.project_id, pf.file_path, pf.file_hash, (row_number() over (partition by pf.project_id, pf.file_path order by position, chunk_id) - 1)::int as position, chunk_id, content_hash as chunk_hash from pf left join pc on pc.project_id = pf.project_id and pc.file_path = pf.file_path),
      old as (select x.* from mm x where not exists (select 1 from pf y where {SAME})),
      olds as (select project_id, file_path, file_hash, unnest(case when len(chunk_ids) > 0 then chunk_ids else [null] end) as chunk_id, chunk_hashes, generate_subscripts(case when len(chunk_ids) > 0 then chunk_ids else [null] end, 1) - 1 as i from old)
      select project_id, file_path, file_hash, case when chunk_id is null then null else position end as position, chunk_id, chunk_hash from new
      union all select project_id, file_path, file_hash, case when chunk_id is null then null else i::int end, chunk_id, chunk_hashes[chunk_id] from olds""",
    "manifest_explode": f"with {ENTRIES} select project_id, file_path, chunk_id, chunk_hash from entries",
    "manifest_stats": f"with {LATEST} select count(*) as file_count, coalesce(sum(len(chunk_ids)), 0)::bigint as chunk_count from mm",
    "manifest_roundtrip": f"with {ENTRIES} select project_id, file_path, chunk_id, chunk_hash from entries",
    "vector_upsert": f"with {EXISTING}, nw as (select * from points where not coalesce(indexed_at < '2025-11-15 00:00:00+00'::timestamptz, false) qualify {ONE}) select {STORE_OUT} from ex where point_id not in (select point_id from nw) union all select {STORE_OUT} from nw",
    "vector_delete_ids": f"with {EXISTING} select {STORE_OUT} from ex where point_id not in (select point_id from points where symbol_type = 'heading')",
    "vector_delete_project": f"with {EXISTING} select {STORE_OUT} from ex where project_id is distinct from 'orchid-core'",
    "full_reindex": f"with {EXISTING}, nw as (select * from points where project_id = 'orchid-core' and symbol_type = 'file' qualify {ONE}) select {STORE_OUT} from ex where project_id is distinct from 'orchid-core' and point_id not in (select point_id from nw) union all select {STORE_OUT} from nw",
    "vector_topk": topk("true", 10),
    "vector_topk_filtered": topk("project_id = 'orchid-core' and symbol_type = 'function'", 10),
    "vector_topk_threshold": topk("project_id = 'orchid-core'", 20, "s >= 0.3"),
    "vector_topk_batch": f"with {BATCH} select query_id, rank, point_id, round(score, 6) as score from best",
    "embed_batches": "with k as (select chunk_id, max(project_id) as project_id, substr(sha256(chunk_id), 1, 16) as h from points where chunk_id is not null and project_id is not null group by chunk_id) select chunk_id, project_id, ((row_number() over (partition by project_id order by h, chunk_id) - 1) // 32)::int as batch from k",
    "oversized_chunks": f"with {UNIQUE}, {OVERSIZED} select * from ov",
    "oversized_report": f"with {UNIQUE}, {OVERSIZED} select project_id, count(*) as total_count, max(max_allowed) as max_tokens_allowed, max(token_count) as largest_tokens, sum(content_size_bytes)::bigint as total_bytes from ov group by project_id",
    "index_project_summary": f"with {COUNTER_CTES} select * from s",
    "index_all_summary": f"with {COUNTER_CTES} select project_id, 0 as is_total, 1::bigint as projects, {SUMS} from s group by project_id union all select null, 1, count(*), {SUMS} from s",
    "progress_stats": f"with {F_}, d as (select strlen(text) / 1000 as seconds from f) select count(*) as processed, round(avg(seconds), 6) as avg_seconds, round(round(avg(seconds), 6) * 100, 6) as eta_seconds, round(count(*) * 100.0::double / (count(*) + 100), 4) as percent from d",
    "list_projects": "select project_id, count(distinct point_id) as chunk_count from points where project_id is not null group by project_id",
    "retrieve_projection": f"with {BATCH}, {PAYLOAD}, {PROJECTED} select * from pr",
    "render_results_markdown": f"""with {BATCH}, {PAYLOAD}, {PROJECTED}, t as (select query_id, rank, score, {', '.join(f"coalesce({c}::varchar, 'undefined') as {c}" for c in ('source', 'start_line', 'end_line', 'symbol', 'symbol_type', 'language', 'content'))} from pr)
      select query_id, rank, format('### {{}}:{{}}-{{}}', source, start_line, end_line) || chr(10) || format('**{{}}** ({{}}) | Score: {{}}%', symbol, symbol_type, round(score * 100, 1)::decimal(10, 1)) || chr(10) || '```' || language || chr(10) || content || chr(10) || '```' || chr(10) || chr(10) as markdown from t""",
}
