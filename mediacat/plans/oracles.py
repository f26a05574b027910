"""Plain SQL that gives the same rows as each query, for checking against another engine."""

from __future__ import annotations

from mediacat.functions import constants as K
from mediacat.plans.views import ctes


def _list(values) -> str:
    return "(" + ",".join(f"'{v}'" for v in values) + ")"


ACTIVE = _list(K.ACTIVE_STATES)
STUCK = _list(K.STUCK_STATES)


def _state_count(view: str) -> str:
    return f"count(*) filter (where state in {_list(K.JOB_VIEWS[view])}) as {view}"


# Longest matching blocks of each pair of titles, again and again to the left and right of what is found: the earliest
# in the title, then the earliest in the query. All pairs of titles and queries are held to the candidates' rule.
MATCHES = """
with recursive named as (select p_partkey as file_id, {title} as title,
   cast(case when p_partkey%3=1 then 1950+p_partkey%75 end as integer) as year, p_partkey%3=0 as is_tv,
   case when p_partkey%3=0 then 1+p_partkey%9 end as season, case when p_partkey%3=0 then 1+p_partkey%20 end as episode from part),
 wanted as (select distinct lower(title) as q, year, is_tv from named),
 entries as (select p_partkey%2=1 as is_tv, lower(p_name) as t, 1950+p_partkey%75 as cyear, cast(p_size as double) as pop,
   p_partkey as title_id, p_name as title from part),
 texts as (select distinct is_tv, q as s from wanted union select distinct is_tv, t from entries),
 grams as (select is_tv, s, substr(' '||s||' ', i, 2) as g, row_number() over (partition by is_tv, s, substr(' '||s||' ', i, 2)) as k
   from texts, unnest(range(1, length(s)+2)) as u(i)),
 shared as (select a.is_tv, a.s as q, b.s as t, count(*) as n from grams a join grams b using (is_tv, g, k) group by 1,2,3),
 near as (select * from shared where 5*n >= length(q)+length(t)+2 and (is_tv,q) in (select is_tv,q from wanted)
   and (is_tv,t) in (select is_tv,t from entries)),
 parts as (select distinct q, t, t as a, q as b, 0 as k from near
   union all
   select q, t, case when side=0 then substr(a,1,i-1) else substr(a,i+n) end,
     case when side=0 then substr(b,1,strpos(b,substr(a,i,n))-1) else substr(b,strpos(b,substr(a,i,n))+n) end, case when side=0 then n else 0 end
   from (select *, -best.i as i, best.n as n from (select *, list_max(list_transform(range(1,length(a)+1), lambda i:
       {{'n': list_max(list_filter(range(0,length(a)-i+2), lambda n: contains(b, substr(a,i,n)))), 'i': -i}})) as best from parts where a<>'' and b<>'')),
     (values (0),(1)) as s(side) where n > 0),
 ratios as (select q, t, 2.0*cast(sum(k) as double)/(length(q)+length(t)) as ratio from parts group by q, t),
 scored as (select w.q, w.year, w.is_tv, e.*exclude(is_tv), r.ratio
     + case when w.year is null then 0.0 when e.cyear=w.year then 0.15 when abs(e.cyear-w.year)=1 then 0.05 else -0.20 end
     + least(e.pop/1000, 0.05) as score, coalesce(e.cyear=w.year, false) as same
   from wanted w join near n on n.q=w.q and n.is_tv=w.is_tv join ratios r on r.q=n.q and r.t=n.t join entries e on e.t=n.t and e.is_tv=w.is_tv),
 ranked as (select *, row_number() over (partition by q, year, is_tv order by score desc, pop desc, title_id) as rn from
   (select *, max(same) over (partition by q, year, is_tv) as any_same from scored) where is_tv or year is null or same or not any_same),
 matches as (select q, year, is_tv, title_id, title as match_title, cast(cyear as integer) as match_year,
   cast(h + case when x-h>0.5 or x-h=0.5 and h%2=1 then 1 else 0 end as double)/100 as confidence
   from (select *, floor(x) as h from (select *, 100*cast(cast(least(score,1.0) as varchar) as decimal(30,20)) as x from ranked))
   where rn=1 and score >= 0.62)
"""

NAME = "lower(regexp_replace(path,'^.*/',''))"
EXT = "lower(regexp_replace(path,'^.*[.]',''))"
TIER = "case when height>=1600 then 'uhd' when height>=1000 then 'fullhd' when height>=700 then 'hd' else 'sd' end"


def _items(column: str) -> str:
    """Comma list as lower-case items without leading dots."""
    return (
        f"list_transform(list_filter(string_split({column},','), lambda x: x <> ''), "
        "lambda x: regexp_replace(lower(x),'^[.]+',''))"
    )


# Every file with its skip code and conversion action.
DECIDED = (
    ctes("v_files", "v_rules", "v_libraries")
    + f""", named as (
 select f.*, r.*exclude(library_id), l.enabled, {NAME} as nm, {EXT} as ext,
   video_bitrate/1000.0 as kbps, size/1048576.0 as mib, duration_s/60.0 as mins, {TIER} as tier
 from v_files f join v_rules r on r.library_id = f.library_id
 join v_libraries l on l.library_id = f.library_id),
 ceilinged as (select *, case tier when 'sd' then coalesce(nullif(ceil_sd,0),1500)
   when 'hd' then coalesce(nullif(ceil_hd,0),3000) when 'fullhd' then coalesce(nullif(ceil_fullhd,0),6000)
   else coalesce(nullif(ceil_uhd,0),18000) end as ceiling from named),
 judged as (select *,
   (ceiling_on=0 or kbps=0 or kbps<=ceiling) as efficient,
   case when only_ext<>'' and not list_contains({_items('only_ext')}, ext) then 'only_extensions'
     when list_contains({_items('skip_ext')}, ext) then 'skip_extensions'
     when only_name<>'' and not contains(nm, only_name) then 'only_name_contains'
     when len(list_filter({_items('skip_name')}, lambda x: contains(nm, x))) > 0 then 'skip_name_contains'
     when min_mb<>0 and mib<min_mb then 'min_size_mb' when max_mb<>0 and mib>max_mb then 'max_size_mb'
   end as cheap,
   case when min_minutes<>0 and mins<>0 and mins<min_minutes then 'min_minutes'
     when max_minutes<>0 and mins<>0 and mins>max_minutes then 'max_minutes'
     when min_kbps<>0 and kbps<>0 and kbps<min_kbps then 'min_bitrate_kbps'
     when max_kbps<>0 and kbps<>0 and kbps>max_kbps then 'max_bitrate_kbps'
     when list_contains({_items('skip_codecs')}, video_codec) then 'skip_video_codecs' end as costly
   from ceilinged),
 planned as (select *, coalesce(cheap,costly) as skip_code,
   (want_video='copy' or (video_codec=want_video and efficient)) as video_ok,
   (want_audio='copy' or audio_codec=want_audio) as audio_ok, ext=want_container as box_ok from judged),
 decided as (select *, case when video_ok and audio_ok and box_ok then 'skip'
   when video_ok and audio_ok then 'remux' when video_ok then 'audio_only'
   when audio_ok then 'video_only' else 'full' end as action from planned)
"""
)

# Jobs with the place their archived source was found, for jobs of any state.
ARCHIVED = (
    ctes("v_inventory", "v_jobs", "v_originals", "v_libraries")
    + """, homes as (select *, case when output_path is not null
     then concat(regexp_replace(output_path,'/[^/]*$',''),'/Originals/',name)
     else concat(watch_path,'/Originals') end as home from v_libraries where original_action='archive'),
 ledgered as (select job_id, min(archived_path) as p from v_originals
   where archived_path in (select path from v_inventory) group by job_id),
 wanted as (select j.id, h.home, regexp_replace(j.path,'^.*/','') as nm,
     concat(h.home,'/',case when starts_with(j.path,concat(h.watch_path,'/'))
       then substr(j.path,length(h.watch_path)+2) else regexp_replace(j.path,'^.*/','') end) as guess
   from v_jobs j join homes h on h.library_id=j.library_id),
 guessed as (select w.id, w.guess as p from wanted w where w.guess in (select path from v_inventory)),
 inv as (select path, regexp_replace(path,'^.*/','') as nm from v_inventory),
 hunted as (select w.id, min(i.path) as p from wanted w join inv i on i.nm=w.nm
   and starts_with(i.path,concat(w.home,'/')) group by w.id),
 archived as (select j.*, coalesce(l.p,g.p,s.p) as archived,
     case when l.p is not null then 'ledger' when g.p is not null then 'expected'
       when s.p is not null then 'searched' end as found_by
   from v_jobs j left join ledgered l on l.job_id=j.id left join guessed g on g.id=j.id
   left join hunted s on s.id=j.id)
"""
)

SCAN_NOW = "(select max(mtime_s)+30 from v_files)"
NOW = "(select max(created_s)+3600 from v_jobs)"
DAY = "cast(floor((created_s+3600)/86400.0) as bigint)"

VERDICT = (
    "case when coalesce(size_before,0)=0 or coalesce(size_after,0)=0 then 'unknown' "
    "when size_after>=size_before then 'larger' "
    "when coalesce(min_saving,0)<>0 and (cast(size_before-size_after as double)/size_before)*100<min_saving "
    "then 'below_minimum' else 'worth_it' end"
)


def _rung(base: str, offset: int) -> str:
    return f"least(40,{base}+{offset})"


LADDERS = (
    "ladders as (select l.library_id, l.name as library_name, l.min_saving, r.salvage_on, "
    "case when auto_retry=0 then [] else list_sort(list_distinct(list_filter(["
    f"case when steps='' or list_contains(string_split(steps,','),'small') then {_rung('base_quality',4)} end,"
    f"case when steps='' or list_contains(string_split(steps,','),'smaller') then {_rung('base_quality',8)} end,"
    f"case when list_contains(string_split(steps,','),'smallest') then {_rung('base_quality',12)} end,"
    "case when list_contains(string_split(steps,','),'custom') and custom_quality<>0 "
    "then greatest(1,least(51,custom_quality)) end], lambda x: x is not null))) end as ladder "
    "from v_libraries l join v_retry r on r.library_id=l.library_id)"
)

# Names: the views build them from p_name, so the tidy title can be had from there.
TITLE = (
    "array_to_string(list_transform(string_split(p_name,' '), "
    "lambda x: concat(upper(substr(x,1,1)),substr(x,2))),' ')"
)

STREAM_SPEC = (
    ctes("v_streams")
    + """, s as (select *, lower(coalesce(language,'und')) as code, lower(title) as lt,
   file_id%3<>0 as remove_other, case file_id%4 when 0 then 'strip' when 1 then 'forced'
     when 2 then 'languages' else 'keep' end as mode, file_id%5<>0 as keep_forced,
   file_id%2=1 as odd from v_streams),
 f as (select *, (forced=1 or contains(lt,'forced') or contains(lt,'signs') or contains(lt,'songs')) as is_f,
   codec_type='audio' and code in ('en','fr','und') as wanted from s),
 g as (select *, max(case when wanted then 1 else 0 end) over (partition by file_id) as any_wanted,
   min(case when codec_type='video' then idx end) over (partition by file_id) as main from f),
 k as (select *, case
   when codec_type='video' and idx<>main then 'extra_video'
   when codec_type='audio' and not wanted and remove_other and any_wanted=1 then 'other_language'
   when codec_type='subtitle' and not (case mode when 'strip' then keep_forced and is_f
     when 'forced' then is_f when 'languages' then code in ('de','es') or (keep_forced and is_f)
     else true end) then 'subtitle_mode'
   when codec_type='subtitle' and codec_name in ('eia_608','eia_708') then 'caption'
   when codec_type='subtitle' and odd and codec_name='hdmv_pgs_subtitle' then 'picture_subtitle'
   end as drop_reason from g),
 r as (select *, drop_reason is null as kept, row_number() over (
   partition by file_id, codec_type, drop_reason is null order by
   case when codec_type='subtitle' then (case when is_f then 0 else 1 end)
     when codec_type='audio' then (case when wanted then 0 else 1 end) else 0 end,
   case when codec_type='subtitle' then (case code when 'de' then 0 when 'es' then 1 else 2 end)
     when codec_type='audio' and wanted then (case code when 'en' then 0 when 'fr' then 1 else 2 end) else 0 end,
   case when codec_type='audio' and wanted and contains(lt,'commentary') then 1 else 0 end,
   case when codec_type='audio' and wanted then -channels else 0 end, idx) - 1 as pos from k),
 plan as (select file_id, idx, codec_type, kept, drop_reason,
   case when kept then cast(pos as bigint) end as position,
   kept and pos=0 and (codec_type='audio' or (codec_type='subtitle' and odd)) as is_default,
   kept and codec_type='subtitle' and is_f as is_forced, mode, code from r)
"""
)

# Log lines of the fixed six kinds, cleaned by hand.
CAUSES = (
    ctes("v_loglines", "v_failed")
    + """, kept as (select * from v_loglines where kind<>-1),
 cleaned as (select *, case kind when 0 then 'audio track 2: Error sending frames to consumers: Invalid data found'
     when 4 then 'video track 1: Task finished with error code: -22'
     else line end as cause, kind<>3 as is_error, kind in (2,4) as noise, kind=0 as audio from kept),
 firsts as (select *, min(case when is_error then line_no end) over (partition by job_id) as first_no from cleaned),
 hits as (select job_id, cause, min(line_no) as line_no, bool_or(audio) as audio from firsts
   where is_error and (not noise or line_no=first_no) group by job_id, cause),
 placed as (select *, row_number() over (partition by job_id order by
     case when contains(cause,'audio track') or contains(cause,'video track') then 0 else 1 end, line_no) as n from hits),
 pairs as (select job_id, max(case when n=1 then cause end) as cause_1, max(case when n=2 then cause end) as cause_2,
     bool_or(audio) as audio_related from placed group by job_id),
 said as (select job_id, arg_max(line,line_no) as last_line, arg_max(kind,line_no) as last_kind from kept group by job_id),
 jobs as (select f.job_id, f.returncode, case last_kind when 0 then 'audio track 2: Error sending frames to consumers: Invalid data found'
     when 1 then 'Could not write header: Invalid data' when 4 then 'video track 1: Task finished with error code: -22'
     else last_line end as last_line from v_failed f left join said s on s.job_id=f.job_id),
 causes as (select j.job_id, p.cause_1, p.cause_2, coalesce(p.audio_related,false) as audio_related, j.last_line,
     cast(case when j.returncode>2147483648 then j.returncode-4294967296 else j.returncode end as bigint) as exit_code
   from jobs j left join pairs p on p.job_id=j.job_id)
"""
)

EVENTS = (
    ctes("v_progress")
    + """, e as (select *, cast(floor(epoch(ts)) as bigint) as at_s,
   last_value(case when kind<>'progress' then kind end ignore nulls) over (partition by job_id
     order by ts, event_id rows between unbounded preceding and 1 preceding) as before from v_progress),
 a as (select *, kind='progress' and coalesce(before,'started')='started' as accepted from e),
 b as (select *, last_value(case when kind='started' then 0.0 when accepted then progress end ignore nulls) over
   (partition by job_id order by ts, event_id rows between unbounded preceding and 1 preceding) as prev from a),
 c as (select *, accepted and progress>coalesce(prev,0.0) as moved from b),
 latest as (select job_id,
   case last(kind order by ts, event_id) filter (where kind<>'progress') when 'complete' then 'done'
     when 'fail' then 'failed' else 'running' end as state,
   coalesce(last(case when kind='started' then 0.0 else progress end order by ts, event_id)
     filter (where kind='started' or accepted), 0.0) as progress,
   last(size_now order by ts, event_id) filter (where accepted) as size_now,
   max(at_s) filter (where moved) as progress_s,
   max(at_s) filter (where kind='started') as started_s,
   max(at_s) filter (where kind='started' or accepted) as seen_s,
   count(*) filter (where accepted) as accepted,
   count(*) filter (where kind='progress' and not accepted) as refused
   from c group by job_id)
"""
)

ELIGIBLE = (
    ctes("v_jobs", "v_nodes", "v_bench")
    + """, skills as (select distinct node_id, family as codec from v_bench where fps8 is not null
   union select node_id, 'copy' from v_nodes),
 pairs as (select j.id, j.path, j.codec, n.node_id, n.slots, n.enabled, n.mount_server, n.mount_local,
   coalesce(starts_with(j.path,n.mount_server||'/'),false) as local
   from v_jobs j join skills s on s.codec=j.codec join v_nodes n on n.node_id=s.node_id
   where j.state='queued' and n.enabled=1 and (coalesce(starts_with(j.path,n.mount_server||'/'),false)
     or (j.codec<>'copy' and (coalesce(j.size_before,0)=0 or j.size_before>=536870912))))
"""
)


def _speed(want: str, depth: int) -> str:
    cliff = "fps8<>0 and fps10<>0 and fps10<fps8*0.4"
    ten = "case when fps10=0 then 0.0 else coalesce(fps10,fps8,0.0) end"
    if want == "10":
        return ten
    if depth <= 8:
        return "coalesce(fps8,0.0)"
    return f"case when fps10=0 or coalesce({cliff},false) then coalesce(fps8,0.0) else {ten} end"


def _best(case: str, want: str, depth: int) -> str:
    listed = [e for members in K.CODEC_FAMILIES.values() for e in members]
    pref = "case encoder " + " ".join(f"when '{e}' then {i}" for i, e in enumerate(listed)) + " end"
    hw = "(" + " or ".join(f"encoder like '%{s}'" for s in K.HARDWARE_SUFFIXES) + ")"
    return f"""select '{case}' as "case", node_id, family,
 case when hw_fps>=best_fps*0.75 then hw else coalesce(best,first_listed) end as encoder,
 case when hw_fps>=best_fps*0.75 then hw_fps else coalesce(best_fps,0.0) end as fps from (
 select node_id, family, first(encoder order by pref) as first_listed,
  first(encoder order by speed desc, pref) filter (where speed>0) as best,
  max(speed) filter (where speed>0) as best_fps,
  first(encoder order by speed desc, pref) filter (where speed>0 and hw) as hw,
  max(speed) filter (where speed>0 and hw) as hw_fps
 from (select *, {_speed(want, depth)} as speed, {pref} as pref, {hw} as hw from v_bench)
 group by node_id, family)"""


def _title_sql() -> str:
    """Track titles of the fixed set of codes and titles in the stream view."""
    return (
        ctes("v_streams")
        + """, s as (select *, lower(title) as lt,
 case language when 'en' then 'English' when 'fr' then 'French' when 'de' then 'German' when 'es' then 'Spanish' end as tagged
 from v_streams where codec_type in ('audio','subtitle')),
 n as (select *, coalesce(tagged, case when title='French Audio' then 'French' end) as known,
  case when tagged is not null then lower(language) when title='French Audio' then 'fre' end as found,
  case channels when 2 then 'Stereo' when 6 then '5.1' else '7.1' end as layout,
  (forced=1 or lt='signs') as is_f from s)
select file_id, idx, case when known is null then null when codec_type='audio' then
  concat(known,' ',layout,case when contains(lt,'commentary') then ' (Commentary)' else '' end)
 when is_f and lt='sdh' then concat(known,' (Forced, SDH)') when is_f then concat(known,' (Forced)')
 when lt='sdh' then concat(known,' (SDH)') else known end as new_title,
 case when known is not null then found end as code from n"""
    )


def _bigint_sum(expr: str) -> str:
    return f"cast(sum({expr}) as bigint)"


ORACLES: dict[str, str] = {
    "conversion_plan": DECIDED
    + f"select library_id, action, count(*) as files, {_bigint_sum('size')} as bytes from decided "
    "where skip_code is null group by 1,2",
    "plan_reasons": DECIDED
    + """select coalesce(skip_code, case action when 'skip' then 'nothing to change'
 when 'remux' then concat('new container: ',upper(want_container))
 when 'audio_only' then concat('video stays ',video_codec,', audio from ',audio_codec,' to ',upper(want_audio))
 when 'video_only' then concat('audio stays ',upper(want_audio),', video to ',upper(want_video))
 else concat('video to ',upper(want_video),', audio to ',upper(want_audio)) end) as reason, count(*) as files
 from decided group by 1""",
    "processed_upserts": ctes("v_scan")
    + """, seen as (select *, (scan_s-1700000000)//30%3 as n, row_number() over (partition by path, (scan_s-1700000000)//30%3
   order by scan_s desc, size desc, library_id desc) as rn from v_scan),
 noted as (select path, n, mtime_s, scan_s, size, case when n>0 or file_id%4<>0 then library_id+100*n end as library_id
   from seen where rn=1)
 select path, arg_max(mtime_s,n) as mtime_s, arg_max(scan_s,n) as scan_s, arg_max(size,n) as size,
   arg_min(library_id,n) filter (where library_id is not null) as library_id from noted group by path""",
    "inventory_latest": ctes("v_files")
    + "select file_id, path, scan_s, size, height, video_codec, audio_codec, duration_s from v_files",
    "skip_reasons": DECIDED
    + "select library_id, case when cheap is not null then 'listing' else 'probe' end as phase, "
    "skip_code as code, count(*) as files from decided where skip_code is not null group by 1,2,3",
    "scan_funnel": DECIDED
    + f""", staged as (select case when file_id%83<>5 then d.library_id end as library_id,
 case when file_id%83=5 then 'no_library' when enabled=0 then 'paused'
 when file_id%89=6 then 'not_video' when file_id%79=7 then 'skipped_folder'
 when {SCAN_NOW}-mtime_s<=90 then 'arriving' when file_id%12=0 then 'handled'
 when skip_code is not null then 'skip_rule' when file_id%97=0 then 'unreadable'
 when action='skip' then 'already_right' else 'wanted' end as stage from decided d)
 select library_id, stage, count(*) as files from staged group by 1,2""",
}


def _scan_report() -> str:
    views = ctes("v_files", "v_rules", "v_libraries", "v_jobs", "v_processed")
    steps = DECIDED[len(ctes("v_files", "v_rules", "v_libraries")) :]
    return (
        views
        + steps
        + f""", stuck as (select path, size_before from (select *, row_number() over (partition by path
   order by id desc) as rn from v_jobs where state in {STUCK}) where rn=1),
 sights as (select path, size, row_number() over (partition by path order by scan_s desc, size desc) as rn from v_scan),
 steady as (select path from sights where rn<=2 group by path
   having max(case when rn=1 then size end)=max(case when rn=2 then size end)),
 rest as (select d.* from decided d where enabled=1
   and not exists (select 1 from v_processed p where p.path=d.path and abs(p.mtime_s-d.mtime_s)<1)
   and not exists (select 1 from stuck s where s.path=d.path and s.size_before=d.size)),
 told as (select r.library_id, case when {SCAN_NOW}-mtime_s<=90 and r.path not in (select path from steady) then 'waiting'
   when skip_code is not null then 'filtered_out' when action='skip' and skip_matching=1 then 'already_ok'
   when r.path in (select path from v_jobs where state in {ACTIVE}) then 'has_job' else 'queued' end as o from rest r)
 select library_id, count(*) filter (where o='queued') as queued, count(*) filter (where o='waiting') as waiting,
 count(*) filter (where o='already_ok') as already_ok, count(*) filter (where o='filtered_out') as filtered_out
 from told group by 1"""
    )


def _filed_rows() -> str:
    """Libraries 0 and 1 leave matching files alone and have an output folder. 0 keeps the names, which tell
    nothing; 1 renames whatever they tell: a folder and a file in title case."""
    views = ctes("v_files", "v_rules", "v_libraries", "v_jobs")
    return (
        views
        + ", moved as (select * replace (case when file_id%4=3 then concat('/media/lib',library_id,'/d',file_id%2,'/g',"
        "cast(floor(file_id/64.0) as bigint),'.',regexp_replace(path,'^.*[.]','')) else path end as path) from v_files)"
        + DECIDED[len(ctes("v_files", "v_rules", "v_libraries")) :].replace("from v_files f", "from moved f")
        + f""", wanted as (select path, size, library_id, ext, regexp_replace(nm,'[.][^.]*$','') as bare from decided
   where skip_code is null and action='skip' and library_id in (0,1)),
 targets as (select *, case when library_id=0 then concat('/out/lib0/',bare,'.',ext) else
   concat('/out/lib1/',upper(bare[1:1]),bare[2:],'/',upper(bare[1:1]),bare[2:],'.',ext) end as destination from wanted),
 taken as (select distinct concat('/out/lib',cast(floor(file_id/8.0) as bigint)%5,'/f',file_id,'.',regexp_replace(path,'^.*[.]','')) as path
   from v_files where file_id%41=0),
 marked as (select *, destination in (select path from taken) or path<>min(path) over (partition by destination) as stuck from targets)
 select path, library_id, 'done' as state, size as size_after, destination as final_path from marked
 where not stuck and path not in (select path from v_jobs where state in {ACTIVE})
 union all
 select path, library_id, 'failed', null, null from marked where stuck and path not in (select path from v_jobs)"""
    )


ORACLES["scan_report"] = _scan_report()
ORACLES["filed_rows"] = _filed_rows()
ORACLES.update(
    {
        "tier_profile": ctes("v_files")
        + f"""select library_id, {TIER} as tier, video_codec, bit_depth as depth, count(*) as files,
 {_bigint_sum('size')} as bytes, {_bigint_sum("case when file_id%3<>0 and video_bitrate<>0 then video_bitrate "
 "else greatest(0, cast(floor(size*8/duration_s) as bigint)-192000) end")} as rate_sum,
 count(*) filter (where video_codec='h264' and bit_depth>8) as hi10p from v_files group by 1,2,3,4""",
        "over_ceiling": DECIDED
        + f"select library_id, tier, count(*) as files, {_bigint_sum('video_bitrate')} as bits from decided "
        "where video_codec=want_video and not efficient group by 1,2",
        "unprocessed_files": ctes("v_processed")
        + "select file_id, path, size from v_files f where not exists (select 1 from v_processed p "
        "where p.path=f.path and abs(coalesce(p.mtime_s,0)-f.mtime_s)<1)",
        "stuck_files": ctes("v_jobs")
        + f"""select f.file_id, f.path, f.size, s.id as job_id from v_files f join (select *, row_number() over
 (partition by path order by id desc) as rn from v_jobs where state in {STUCK}) s
 on s.path=f.path and s.rn=1 and s.size_before=f.size""",
        "library_of_file": ctes("v_inventory", "v_libraries")
        + f""", libs as (select library_id, name, watch_path from v_libraries union all
  select * from (values (7,'all','/media'),(8,'aaa','/media/lib4'),(9,'archive','/out/Originals/lib0/')) as t(a,b,c)),
 owned as (select i.path, i.size, (select first(library_id order by name) from libs l
   where starts_with(i.path, concat(rtrim(l.watch_path,'/'),'/'))) as library_id from v_inventory i)
 select cast(library_id as bigint) as library_id, count(*) as files, {_bigint_sum('size')} as bytes from owned group by 1""",
        "enqueue_batch": ctes("v_scan", "v_jobs")
        + f"""select path, scan_s, size, library_id from (select *, row_number() over (partition by path
 order by scan_s, size) as rn from v_scan) where rn=1
 and path not in (select path from v_jobs where state in {ACTIVE})""",
        "enqueue_report": ctes("v_scan", "v_jobs")
        + f"""select count(distinct path) filter (where not busy) as added,
 count(*) - count(distinct path) filter (where not busy) as skipped from (select path,
 path in (select path from v_jobs where state in {ACTIVE}) as busy from v_scan)""",
        "size_stability": ctes("v_scan")
        + """, seen as (select path, scan_s, size-size%100000000 as size from v_scan),
 laid as (select *, row_number() over (partition by path order by scan_s desc, size desc) as rn from seen)
 select path, max(case when rn=1 then size end) as size,
 coalesce(max(case when rn=1 then size end)=max(case when rn=2 then size end),false) as stable
 from laid where rn<=2 group by path""",
        "view_counts": ctes("v_jobs")
        + " union all ".join(
            f"select '{v}' as view, count(*) as jobs from v_jobs where state in {_list(s)}"
            for v, s in K.JOB_VIEWS.items()
        ),
        "counts_by_library": ctes("v_jobs")
        + "select library_id, " + ", ".join(_state_count(v) for v in K.JOB_VIEWS) + " from v_jobs group by 1",
        "job_stats": ctes("v_jobs")
        + """select count(*) filter (where state='done') as done, count(*) filter (where state='failed') as failed,
 count(*) filter (where state='queued') as queued,
 cast(coalesce(sum(size_before) filter (where state='done'),0) as bigint) as before,
 cast(coalesce(sum(size_after) filter (where state='done'),0) as bigint) as after from v_jobs""",
        "lifetime_totals": ctes("v_jobs")
        + f"""select library_id, day, cast(sum(n) over w as bigint) as files_so_far,
 cast(sum(b) over w as bigint) as before_so_far, cast(sum(a) over w as bigint) as after_so_far from (
 select library_id, {DAY} as day, count(*) as n, sum(size_before) as b, sum(size_after) as a from v_jobs
 where state='done' group by 1,2) window w as (partition by library_id order by day)""",
        "lifetime_stats": ctes("v_jobs")
        + f"""select count(*) filter (where state='done') as done, count(*) filter (where state='failed') as failed,
 count(*) filter (where state='queued') as queued, {_bigint_sum("case when state='done' then size_before else 0 end")} as before,
 {_bigint_sum("case when state='done' then size_after else 0 end")} as after from v_jobs""",
        "active_by_node": ctes("v_jobs", "v_nodes")
        + """select cast(n.node_id as bigint) as node_id, n.name, coalesce(a.c,0) as active,
 cast(n.slots-coalesce(a.c,0) as bigint) as free_slots,
 coalesce((select max(progress_s) from v_jobs)-s.seen<45,false) as online from v_nodes n
 left join (select node_id, count(*) as c from v_jobs where state in ('leased','running') group by 1) a on a.node_id=n.node_id
 left join (select node_id, max(progress_s) as seen from v_jobs group by 1) s on s.node_id=n.node_id""",
        "queue_page": ctes("v_jobs")
        + f"""select rn as position, id, path, state from (select *, row_number() over (order by id) as rn from v_jobs
 where state in {ACTIVE}) where rn>120 and rn<=140""",
        "history_page": ctes("v_jobs")
        + """, r as (select *, row_number() over (order by id desc) as rn, count(*) over () as total from v_jobs
 where state='done' and library_id=2)
 select rn as position, id, path, state from r where rn>(ceil(total/100.0)-1)*100""",
        "largest_files": ctes("v_files")
        + "select path, size, library_id from v_files order by size desc, path limit 500",
        "requeue_plan": ctes("v_jobs")
        + f"""select id, case when rn=1 and path not in (select path from v_jobs where state in {ACTIVE})
 then 'requeued' else 'skipped' end as verdict from (select id, path, row_number() over
 (partition by path order by id desc) as rn from v_jobs where state='failed')""",
        "bulk_changes": ctes("v_jobs")
        + f""", n as (select case when state='bloated' and id%5=0 then 'done'
   when state in {ACTIVE} and library_id=1 then 'cancelled' else state end as state, library_id,
   state in {ACTIVE} and coalesce(library_id=1,false) as stopped, state='bloated' and id%5=0 as noted from v_jobs)
 select state, count(*) as jobs, count(*) filter (where stopped) as finished, count(*) filter (where noted) as noted
 from n where not (state='failed' and coalesce(library_id=2,false)) group by 1""",
        "files_with_active_job": ctes("v_jobs")
        + f"""select library_id, count(*) as files, {_bigint_sum('size')} as bytes from v_files
 where path in (select path from v_jobs where state in {ACTIVE}) group by 1""",
        "savings_verdicts": ctes("v_jobs", "v_libraries")
        + f"""select id, {VERDICT} as code, cast(floor(case when coalesce(size_before,0)=0 or coalesce(size_after,0)=0
 then 0 else cast(size_before-size_after as double)/size_before*100 end) as bigint) as percent
 from v_jobs j left join v_libraries l on l.library_id=j.library_id where state in ('done','bloated')""",
        "savings_rollup": ctes("v_jobs", "v_libraries", "v_nodes")
        + """select l.name as library, codec, n.name as node, count(*) as jobs, cast(sum(size_before) as bigint) as before,
 cast(sum(size_after) as bigint) as after,
 cast(floor(cast(sum(size_before)-sum(size_after) as double)*100/cast(sum(size_before) as double)) as bigint) as percent
 from v_jobs j left join v_libraries l on l.library_id=j.library_id left join v_nodes n on n.node_id=j.node_id
 where state='done' group by 1,2,3""",
        "savings_subtotals": ctes("v_jobs", "v_libraries")
        + """select l.name as library, codec, cast(grouping(l.name, codec) as integer) as summed, count(*) as jobs,
 cast(sum(size_before) as bigint) as before, cast(sum(size_after) as bigint) as after,
 cast(floor(cast(sum(size_before)-sum(size_after) as double)*100/cast(sum(size_before) as double)) as bigint) as percent
 from v_jobs j left join v_libraries l on l.library_id=j.library_id where state='done' group by rollup(l.name, codec)""",
        "savings_by_tier": ctes("v_jobs", "v_files")
        + f"""select {TIER} as tier, encoder, count(*) as jobs, cast(sum(size_before) as bigint) as before,
 cast(sum(size_after) as bigint) as after,
 cast(floor(cast(sum(size_before)-sum(size_after) as double)*100/cast(sum(size_before) as double)) as bigint) as percent
 from v_jobs j left join (select path, height from v_files) f on f.path=j.path where state='done' group by 1,2""",
        "refused_reports": ctes("v_jobs")
        + """select case when state not in ('leased','running') then state end as progress_refused_by,
 case when state in ('cancelled','queued') then state end as completion_refused_by, count(*) as jobs from v_jobs group by 1,2""",
        "picture_streams": ctes("v_streams")
        + """select pix_fmt, count(*) as streams, count(*) filter (where color_transfer='smpte2084') as hdr,
 count(*) filter (where file_id%9=0) as images,
 count(*) filter (where color_transfer='smpte2084' and file_id%9<>0) as hdr_pictures
 from v_streams where codec_type='video' group by 1""",
        "resolved_specs": ctes("v_specs")
        + """select video as codec, container, case when audio='' then 'aac' else audio end as audio, subtitle_mode,
 bit_depth, downmix, '160k' as audio_bitrate, cast(22 as bigint) as quality, 'eng' as languages, count(*) as jobs
 from v_specs group by all""",
        "retry_rungs": ctes("v_jobs", "v_libraries", "v_retry")
        + ", " + LADDERS
        + """ select id, array_to_string(ladder,',') as ladder,
 cast(list_filter(ladder, lambda x: x > quality)[1] as bigint) as next_quality, cast(attempt+1 as bigint) as next_attempt
 from v_jobs j join ladders l on l.library_id=j.library_id where state='bloated'""",
        "attempt_chain": ctes("v_jobs")
        + """select path, count(*) as jobs, max(attempt) as attempts, first(id order by attempt desc, id desc) as last_id
 from v_jobs group by path""",
        "archived_source": ARCHIVED
        + "select id, archived, found_by from archived where state in ('done','bloated')",
        "outcome_routing": ARCHIVED
        + ", v_retry as (" + "select * from "
        + ctes("v_retry").split("select * from ", 1)[1]
        + ", " + LADDERS
        + f""", busy as (select distinct path from v_jobs where state in {ACTIVE}),
 cases as (select a.*, l.*exclude(library_id), a.path in (select path from busy) as taken,
   a.id%10=0 as salvage, a.id%3<>0 as related, a.id%4=0 as copied,
   a.archived is not null and l.library_name is not null as restored, {VERDICT} as verdict,
   list_filter(l.ladder, lambda x: x > a.quality)[1] as rung
   from archived a left join ladders l on l.library_id=a.library_id
   where state in ('done','bloated','failed','ignored')),
 routed as (select id, rung, case when state in ('done','bloated') then (case when salvage then 'salvaged'
   when verdict in ('unknown','worth_it') then 'done' when restored and not taken and rung is not null then 'retry_quality'
   when restored and not taken and salvage_on=1 then 'salvage_copy' else 'bloated' end)
   else (case when related and not copied and not taken then 'retry_audio_copy' when related and copied then 'ignored'
   else 'failed' end) end as route from cases)
 select id, route, case when route in ('salvaged','done') then 'done'
 when route in ('retry_quality','salvage_copy','retry_audio_copy') then 'queued' else route end as next_state,
 cast(case when route='retry_quality' then rung end as bigint) as next_quality from routed""",
        "retry_eligibility": ctes("v_jobs", "v_originals", "v_inventory", "v_libraries")
        + """select j.id, case when j.path in (select path from v_inventory) or (o.archived_path is not null
   and o.archived_path in (select path from v_inventory)) then null
 when l.name is null then 'no_library' when l.original_action<>'archive' then 'library_keeps_no_originals'
 when j.id%7=0 then 'kept_no_original_then' when o.archived_path is not null then 'archived_copy_missing'
 else 'never_archived' end as block, j.quality as current_quality, '26,30,34,own' as steps
 from v_jobs j left join v_originals o on o.job_id=j.id left join v_libraries l on l.library_id=j.library_id
 where j.state='bloated'""",
        "overrun_jobs": ctes("v_jobs")
        + f""", o as (select id, {NOW}-started_s as ran_s, case when state in ('leased','running')
   and {NOW}-started_s>432000 then 'overrun' when state='running'
   and {NOW}-coalesce(progress_s,started_s)>259200 then 'stalled' end as code from v_jobs)
 select id, code, ran_s from o where code is not null""",
        "originals_summary": ctes("v_originals")
        + f"""select 'all' as age, count(*) as n, cast(coalesce(sum(size),0) as bigint) as bytes from v_originals
 union all select 'old', count(*), cast(coalesce(sum(size),0) as bigint) from v_originals
 where archived_s<{NOW}-432000""",
        "sweep_plan": ctes("v_originals", "v_inventory").replace(" as (select", " as materialized (select")
        + f"""select o.job_id, case when a.path is null then 'forget' when coalesce(f.size,0)=0 then 'keep'
 else 'delete' end as verdict, case when a.path is not null and coalesce(f.size,0)<>0 then a.size else 0 end as freed,
 f.path is not null as replacement_ok from v_originals o left join v_inventory a on a.path=o.archived_path
 left join v_inventory f on f.path=o.final_path where o.archived_s<{NOW}-172800""",
        "path_mapping": ctes("v_jobs", "v_nodes")
        + """select j.id, case when starts_with(j.path,n.mount_server||'/') then 'local' else 'stream' end as transport,
 case when starts_with(j.path,n.mount_server||'/') then
 concat(n.mount_local,substr(j.path,length(n.mount_server)+1)) else j.path end as node_path, true as returns
 from v_jobs j join v_nodes n on n.node_id=j.node_id""",
        "job_node_pairs": ELIGIBLE
        + """select j.id, j.codec, count(p.node_id) as nodes, count(p.node_id) filter (where p.local) as local_nodes,
 cast(min(p.node_id) as bigint) as first_node from v_jobs j left join pairs p on p.id=j.id
 where j.state='queued' group by 1,2""",
        "next_job_per_node": ELIGIBLE
        + """, working as (select node_id, count(*) as n from v_jobs where state in ('leased','running') group by 1),
 room as (select f.node_id, coalesce(w.n,0) as active,
   floor(coalesce(w.n,0)*(case when f.node_id=0 then 2 else 4 end)/3.0)+f.slots as slots
   from v_nodes f left join working w on w.node_id=f.node_id)
 select cast(node_id as bigint) as node_id, id as job_id,
 case when local then 'local' else 'stream' end as transport,
 case when local then concat(mount_local,substr(path,length(mount_server)+1)) else path end as node_path
 from (select *, row_number() over (partition by node_id order by id) as rn from pairs
 where node_id in (select node_id from room where slots>=1 and active<slots)) where rn=1""",
        "best_encoder": ctes("v_bench")
        + " union all ".join(_best(*c) for c in (("eight", "match", 8), ("ten", "match", 10), ("forced", "10", 10))),
        "encoder_ranking": ctes("v_bench")
        + "select node_id, encoder, fps8, row_number() over (partition by node_id order by fps8 desc, case encoder "
        + " ".join(
            f"when '{e}' then {i}"
            for i, e in enumerate(e for m in K.CODEC_FAMILIES.values() for e in m)
        )
        + " end) as rank from v_bench where fps8 is not null",
        "ten_bit_cliff": ctes("v_bench")
        + "select node_id, encoder, fps8, fps10 from v_bench where fps8<>0 and fps10<>0 and fps10<fps8*0.4",
        "software_fallback": ctes("v_bench")
        + "select encoder, count(*) as nodes from v_bench where fps8<20 group by 1",
        "work_window_share": ctes("v_progress", "v_windows")
        + """, o as (select node_id, exists (select 1 from v_windows w where w.weekday=isodow(p.ts)-1
   and w.start_sec<=extract(hour from p.ts)*3600+extract(minute from p.ts)*60+floor(extract(second from p.ts))
   and extract(hour from p.ts)*3600+extract(minute from p.ts)*60+floor(extract(second from p.ts))<w.end_sec) as open
   from v_progress p)
 select node_id, count(*) as events, count(*) filter (where open) as open,
 cast(floor(count(*) filter (where open)*100.0/count(*)) as bigint) as percent from o group by 1""",
        "release_names": f"""select p_partkey as file_id, {TITLE} as title,
 cast(case when p_partkey%3=1 then 1950+p_partkey%75 end as integer) as year,
 cast(case when p_partkey%3=0 then 1+p_partkey%9 end as integer) as season,
 cast(case when p_partkey%3=0 then 1+p_partkey%20 end as integer) as episode,
 p_partkey%3=0 as is_tv, p_partkey%3<>2 as confident from part""",
        "title_matches": MATCHES.format(title=TITLE) + "select * from matches",
        "enriched_names": MATCHES.format(title=TITLE)
        + """select n.file_id, coalesce(match_title, n.title) as title, coalesce(match_year, n.year) as year,
 cast(title_id as varchar) as tmdb, case when n.is_tv then cast(title_id+100000 as varchar) end as tvdb,
 case when title_id is not null and season=2 and episode=5 then concat('Part ', match_title) end as episode_title,
 title_id is not null as looked_up
 from named n left join matches m on m.q=lower(n.title) and m.year is not distinct from n.year and m.is_tv=n.is_tv""",
        "rename_plan": ctes("v_libraries", "v_naming", "v_files", "v_names")
        + f""", named as (select n.file_id, n.name, l.*exclude(name), g.*exclude(library_id), {TITLE} as title,
   p_partkey%3 as kind from v_names n join part on p_partkey=n.file_id
   join v_libraries l on l.library_id=n.file_id%5 join v_naming g on g.library_id=l.library_id),
 built as (select *, case kind when 1 then concat(title,' (',cast(1950+file_id%75 as varchar),')') else title end as head,
   concat('Season ',lpad(cast(1+file_id%9 as varchar),2,'0')) as season_dir,
   concat(title,' - S',lpad(cast(1+file_id%9 as varchar),2,'0'),'E',lpad(cast(1+file_id%20 as varchar),2,'0'),'.mp4') as episode_name,
   regexp_replace(name,'[.]mkv$','.mp4') as swapped from named),
 placed as (select *, case when output_path is null then concat(watch_path,'/in/',swapped)
   when naming_on=1 and (kind<>2 or skip_uncertain=0) then concat(output_path,'/',case
     when kind=0 and folders=1 then concat(head,'/',season_dir,'/',episode_name) when kind=0 then episode_name
     when folders=1 then concat(head,'/',head,'.mp4') else concat(head,'.mp4') end)
   when mirror_folders=1 then concat(output_path,'/in/',swapped) else concat(output_path,'/',swapped) end as destination from built)
 select file_id, cast(library_id as bigint) as library_id, destination,
 case when destination in (select path from v_files) then 'exists'
 when count(*) over (partition by destination)>1 then 'shared' end as conflict from placed""",
        "track_plan": STREAM_SPEC
        + "select file_id, idx, codec_type, kept, drop_reason, position, is_default, is_forced from plan",
        "track_notes": STREAM_SPEC
        + """select file_id, cast(0 as bigint) as images,
 coalesce(string_agg(distinct code, ', ' order by code) filter (where drop_reason='other_language'),'') as dropped_audio,
 count(*) filter (where drop_reason='caption') as captions,
 count(*) filter (where drop_reason='picture_subtitle') as picture_subtitles,
 count(*) filter (where is_forced and mode='strip') as forced_kept,
 count(*) filter (where codec_type='audio')=0 as kept_all_audio from plan group by 1""",
        "track_titles": _title_sql(),
        "progress_lines": ctes("v_plines")
        + """select job_id, line_no, case when line_no%5=0 then least(99.9,line_no*1000/1e6/600*100) end as progress,
 case when line_no%5=3 then line_no*4096 end as size_now,
 case when line_no%5=1 then cast(line_no%240 as double) end as fps,
 case when line_no%5=2 then cast(line_no%9 as double) end as speed from v_plines""",
        "progress_figures": ctes("v_plines")
        + """select job_id, max(least(99.9,line_no*1000/1e6/600*100)) filter (where line_no%5=0) as progress,
 max(line_no*4096) filter (where line_no%5=3) as size_now,
 cast(arg_max(line_no%240,line_no) filter (where line_no%5=1) as double) as fps,
 cast(arg_max(line_no%9,line_no) filter (where line_no%5=2) as double) as speed from v_plines group by 1""",
        "failure_causes": CAUSES + "select job_id, cause_1, cause_2, audio_related, exit_code from causes",
        "failure_messages": CAUSES
        + """select concat(case exit_code when -1094995529 then 'FFmpeg failed, invalid data in the input'
 when -28 then 'FFmpeg failed, no disk space left' else concat('FFmpeg ended with code ',cast(exit_code as varchar)) end, ': ',
 case when cause_1 is null then coalesce(last_line,'no output') when cause_2 is null then cause_1 else concat(cause_1,' — ',cause_2) end,
 case when audio_related then ' (an audio track could not be decoded: copying the audio unchanged shows whether the rest is sound)' else '' end)
 as message, count(*) as jobs from causes group by 1""",
        "failure_cause_counts": CAUSES
        + "select cause, count(*) as jobs from (select cause_1 as cause from causes union all "
        "select cause_2 from causes) where cause is not null group by 1",
        "spec_audit": ctes("v_specs")
        + """, s as (select *exclude(audio), case when audio='' then 'aac' else audio end as audio, audio='' as blank from v_specs),
 r as (select unnest([case when container='mp4' and audio='opus' then 'mp4_opus' end,
  case when container='mp4' and audio='flac' then 'mp4_flac' end,
  case when container='mp4' and subtitle_mode='keep' then 'mp4_picture_subtitles' end,
  case when video='copy' and job_id%2=0 then 'quality_without_encode' end,
  case when video='av1' then 'av1_slow' end, case when job_id%5=0 then 'sdr_on_processor' end,
  case when bit_depth='10' and video='h264' then 'ten_bit_h264' end,
  case when job_id%4=0 and job_id%8<>0 then 'no_preferred_language' end,
  case when job_id%3=0 and audio='copy' then 'loudness_without_encode' end,
  case when downmix='stereo' then 'stereo_downmix' end,
  case when subtitle_mode='strip' and job_id%2=0 then 'forced_subtitles_lost' end,
  case when blank then 'blank_repaired' end]) as rule from s)
 select rule, count(*) as jobs from r where rule is not null group by 1""",
        "latest_progress": EVENTS
        + """select job_id, state, progress, size_now, progress_s, accepted, refused,
 cast(floor(case when progress<>0 then cast(size_now as double)/(progress/100)/1000000000 end*1000) as bigint) as ratio_permille
 from latest""",
        "stalled_jobs": EVENTS
        + """, n as (select *, (select max(at_s) from c) as now_s from latest where state='running'),
 t as (select job_id, coalesce(seen_s+120<now_s,false) as lease_expired, case when started_s is not null
   and now_s-started_s>432000 then 'overrun' when coalesce(progress_s,started_s) is not null
   and now_s-coalesce(progress_s,started_s)>86400 then 'stalled' end as code from n)
 select job_id, lease_expired, code from t where lease_expired or code is not null""",
        "lease_expiries": EVENTS
        + """, l as (select job_id, at_s, lag(at_s) over (partition by job_id order by ts, event_id) as before_s from c
   where kind='started' or accepted)
 select job_id, count(*) as expiries, max(before_s+120) as last_s from l where at_s-before_s>120 group by 1""",
        "node_sessions": ctes("v_progress")
        + """, e as (select node_id, cast(floor(epoch(ts)) as bigint) as t from v_progress),
 g as (select *, case when t-lag(t) over (partition by node_id order by t)<=600 then 0 else 1 end as fresh from e),
 n as (select *, sum(fresh) over (partition by node_id order by t rows unbounded preceding) as run from g)
 select node_id, min(t) as session_start, max(t) as session_end, count(*) as events from n group by node_id, run""",
        "probed_files": ctes("v_files")
        + """, k as (select *, not (file_id%17=0 or file_id%19=0) as known, not (file_id%17=0 or file_id%19=0 or file_id%23=0) as whole from v_files)
 select path, case when whole then size when known then 0 end as size,
   case when whole then duration_s+cast(0.5 as double) when known then cast(0 as double) end as duration_s,
   case when whole then video_bitrate when known then 0 end as bitrate,
   case when whole then case when file_id%2=0 and video_bitrate-128000<>0 then video_bitrate-128000 else greatest(0, video_bitrate-192000) end
     when known then 0 end as video_bitrate,
   case when whole then video_codec end as video_codec, case when known then case when whole then bit_depth else 8 end end as bit_depth,
   case when whole then height end as height, case when whole then audio_codec when known then '' end as audio from k""",
        "decoded_nodes": """select s_suppkey as id, case when s_suppkey%4<2 then '' else concat('enc',s_suppkey%7,',libx265') end as encoders,
 cast(case when s_suppkey%3=0 then 0 else 1 end as bigint) as mounts, case when s_suppkey%3<>0 then concat('/media/lib',s_suppkey%5) end as server,
 case when s_suppkey%5>1 then greatest(s_suppkey%100+cast(0.5 as double), 20) end as fastest from supplier""",
        "streamed_reports": ctes("v_progress", "v_jobs")
        + """, e as (select p.*, j.state as held, last_value(case when kind<>'progress' then kind end ignore nulls) over
   (partition by job_id order by ts, event_id rows between unbounded preceding and 1 preceding) as before
   from v_progress p left join v_jobs j on j.id=p.job_id),
 c as (select *, kind='progress' and case when before is not null then before='started' else coalesce(held in ('leased','running'), true) end as accepted from e),
 l as (select *, last_value(case when kind='started' then 0.0 when accepted then progress end ignore nulls) over
   (partition by job_id order by ts, event_id rows between unbounded preceding and 1 preceding) as last from c)
 select job_id, count(*) filter (where accepted) as accepted, count(*) filter (where not accepted) as refused,
   max(cast(floor(epoch(ts)) as bigint)) filter (where accepted and progress>coalesce(last,0.0)) as progress_s
 from l where kind='progress' group by 1""",
        "streamed_sessions": ctes("v_progress")
        + """, e as (select node_id, cast(floor(epoch(ts)) as bigint) as t from v_progress),
 g as (select *, case when t-lag(t) over (partition by node_id order by t)<=600 then 0 else 1 end as fresh from e),
 n as (select *, sum(fresh) over (partition by node_id order by t rows unbounded preceding) as run from g)
 select node_id, min(t) as session_start, max(t) as session_end, count(*) as events from n group by node_id, run""",
        "streamed_savings": ctes("v_jobs").replace("coalesce(f_size, cast(floor(o_totalprice*10000) as bigint))", "cast(floor(o_totalprice*10000) as bigint)")
        + f"""select {DAY} as day, count(*) as files, {_bigint_sum('size_before')} as before, {_bigint_sum('size_after')} as after
 from v_jobs where state='done' group by 1""",
        "streamed_requests": ctes("v_scan", "v_jobs")
        + f"select path, count(distinct path) as asked from v_scan where path not in (select path from v_jobs where state in {ACTIVE}) group by 1",
        "daily_savings": ctes("v_jobs")
        + f"""select {DAY} as day, count(*) as files, {_bigint_sum('size_before')} as before,
 {_bigint_sum('size_after')} as after,
 cast(floor(cast(sum(size_before)-sum(size_after) as double)*100/cast(sum(size_before) as double)) as bigint) as percent
 from v_jobs where state='done' group by 1""",
    }
)
