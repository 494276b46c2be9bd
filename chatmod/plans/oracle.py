"""Reference SQL (DuckDB dialect) for the named queries, over the driver's tables.

These are written the plain way — straight joins, windows and brute force —
because they are the yardstick, not the plan that runs at scale.
"""

from __future__ import annotations

# Canonical comment view (see chatmod.plans.views).
_COMMENTS = """
comments as (
  select cast(event_id as varchar) as comment_id, event_type as video_id, cast(user_id as varchar) as author_id,
         'user_' || cast(user_id as varchar) as author_name,
         case when user_id % 3 <> 0 then 'https://img.example/' || cast(user_id as varchar) else '' end as author_image,
         ts - to_seconds(event_id % 90) as published_at, ts as kafka_timestamp,
         (cast(round(value * 100) as bigint) % 1001) / 1000e0 as toxic_score, event_id % 7 as batch_id,
         cast(round(value * 100) as bigint) as v, event_id
  from events),
comments_msg as (
  select c.*, d.text as message from comments c join documents d on c.event_id % (select count(*) from documents) = d.doc_id),
scored as (
  select *, greatest(toxic, severe_toxic, threat, insult, identity_hate) as top_score from (
    select *, (v % 1001) / 1000e0 as toxic, ((v * 3) % 1001) / 1000e0 as severe_toxic,
              ((v * 7) % 1001) / 1000e0 as threat, ((v * 11) % 1001) / 1000e0 as insult,
              ((v * 13) % 1001) / 1000e0 as identity_hate
    from comments_msg)),
scored_comments as (
  select *,
    coalesce(case when abs(toxic - top_score) < 1e-6 then 'toxic' end,
             case when abs(severe_toxic - top_score) < 1e-6 then 'severe_toxic' end,
             case when abs(threat - top_score) < 1e-6 then 'threat' end,
             case when abs(insult - top_score) < 1e-6 then 'insult' end,
             case when abs(identity_hate - top_score) < 1e-6 then 'identity_hate' end) as toxic_category,
    case when top_score >= 0.7 then 'Toxic' else 'Not Toxic' end as toxic_label,
    case when top_score >= 0.9 then 'Ban' when top_score >= 0.7 then 'Hide'
         when top_score >= 0.5 then 'Pending' else 'Safe' end as recommended_action
  from scored)"""


def _with(*ctes: str) -> str:
    return "with " + ",\n".join([_COMMENTS.strip()] + [c.strip() for c in ctes]) + "\n"


def _stream_metric(width: str) -> str:
    return f"""
select video_id, date_trunc('{width}', kafka_timestamp) as window_start,
       date_trunc('{width}', kafka_timestamp) + interval 1 {width} as window_end,
       count(comment_id) as total_comments,
       cast(sum(cast(toxic_score > 0.7 as bigint)) as bigint) as toxic_count,
       count(distinct author_id) as unique_viewers,
       case when count(comment_id) > 0
            then round(sum(cast(toxic_score > 0.7 as bigint)) / count(comment_id), 3) else 0.0 end as toxic_ratio
from comments group by 1, 2, 3"""


def _user_metric_1m() -> str:
    return """
select video_id, author_id, max(author_name) as author_name, max(author_image) as author_image,
       count(comment_id) as total_comments, cast(sum(cast(toxic_score >= 0.7 as bigint)) as bigint) as toxic_count,
       max(case when toxic_score >= 0.7 then published_at end) as last_violation_time,
       round(sum(cast(toxic_score >= 0.7 as bigint)) / count(comment_id), 3) as toxic_ratio,
       date_trunc('minute', kafka_timestamp) as window_start,
       date_trunc('minute', kafka_timestamp) + interval 1 minute as window_end
from comments group by video_id, author_id, date_trunc('minute', kafka_timestamp)
having sum(cast(toxic_score >= 0.7 as bigint)) > 0"""


_STREAM_PARTS_DAY = """
stream_parts as (
  select batch_id, video_id, date_trunc('day', kafka_timestamp) as window_start,
         date_trunc('day', kafka_timestamp) + interval 1 day as window_end,
         count(comment_id) as total_comments, cast(sum(cast(toxic_score > 0.7 as bigint)) as bigint) as toxic_count,
         count(distinct author_id) as unique_viewers
  from comments group by 1, 2, 3, 4)"""

_STREAM_PARTS_HOUR = _STREAM_PARTS_DAY.replace("'day'", "'hour'").replace("interval 1 day", "interval 1 hour")

_USER_PARTS_DAY = """
user_parts_all as (
  select batch_id, video_id, author_id, date_trunc('day', kafka_timestamp) as window_start,
         date_trunc('day', kafka_timestamp) + interval 1 day as window_end,
         max(author_name) as author_name, max(author_image) as author_image,
         count(comment_id) as total_comments, cast(sum(cast(toxic_score >= 0.7 as bigint)) as bigint) as toxic_count,
         max(case when toxic_score >= 0.7 then published_at end) as last_violation_time
  from comments group by 1, 2, 3, 4, 5),
user_parts as (select * from user_parts_all where toxic_count > 0)"""

_MERGED_USER = """
select video_id, author_id, max_by(author_name, batch_id) as author_name, max_by(author_image, batch_id) as author_image,
       cast(sum(total_comments) as bigint) as total_comments, cast(sum(toxic_count) as bigint) as toxic_count,
       max(last_violation_time) as last_violation_time,
       case when sum(total_comments) > 0 then round(sum(toxic_count) / sum(total_comments), 3) else 0.0 end as toxic_ratio,
       window_start, max(window_end) as window_end, count(*) as version
from {src} group by video_id, author_id, window_start"""


def _merged_stream(src: str = "stream_parts", rnd: str = "round") -> str:
    return f"""
select video_id, window_start, max(window_end) as window_end, cast(sum(total_comments) as bigint) as total_comments,
       cast(sum(toxic_count) as bigint) as toxic_count, cast(sum(unique_viewers) as bigint) as unique_viewers,
       case when sum(total_comments) > 0 then {rnd}(sum(toxic_count) / sum(total_comments), 3) else 0.0 end as toxic_ratio,
       count(*) as version
from {src} group by video_id, window_start"""


_USER_1M_PARTS = """
user_1m as (
  select batch_id, video_id, author_id, date_trunc('minute', kafka_timestamp) as window_start,
         max(author_name) as author_name, max(author_image) as author_image,
         cast(sum(cast(toxic_score >= 0.7 as bigint)) as bigint) as toxic_count
  from comments group by 1, 2, 3, 4 having sum(cast(toxic_score >= 0.7 as bigint)) > 0)"""

_USER_1M = """
user_1m_single as (
  select video_id, author_id, date_trunc('minute', kafka_timestamp) as window_start,
         max(author_name) as author_name, max(author_image) as author_image,
         cast(sum(cast(toxic_score >= 0.7 as bigint)) as bigint) as toxic_count
  from comments group by 1, 2, 3 having sum(cast(toxic_score >= 0.7 as bigint)) > 0),
totals as (
  select video_id, author_id, max(author_name) as author_name, max(author_image) as author_image,
         cast(sum(toxic_count) as bigint) as toxic_count
  from user_1m_single group by 1, 2),
top_all as (
  select * from (
    select video_id, cast(row_number() over (partition by video_id order by toxic_count desc, author_id) as integer) as rank,
           author_id, author_name, author_image, toxic_count from totals) where rank <= 5)"""

_FEED_COLS = ("comment_id, video_id, author_id, author_name, author_image, message, published_at, "
              "toxic_label, toxic_category, recommended_action")

_DOC_CLEAN = r"""
docs_clean as (
  select doc_id, trim(regexp_replace(regexp_replace(lower(nfc_normalize(coalesce(text, ''))),
                 '(https?://\S+|www\.\S+|\S+@\S+)', '', 'g'), '\s+', ' ', 'g')) as message_clean
  from documents where text is not null)"""

_TURN_CLEAN = _DOC_CLEAN.replace("docs_clean as", "turns_clean as").replace(
    "select doc_id,", "select conv_id, turn,").replace("from documents", "from conversations")

_LEX = {
    "toxic": "trash|scum", "severe_toxic": "idiot|clown", "threat": "worthless|moron",
    "insult": "pathetic|loser", "identity_hate": "stupid|disgusting",
}


def _lex_score(label: str) -> str:
    return (f"round(1 - pow(0.5, len(regexp_extract_all(message_clean, '\\b({_LEX[label]})\\b'))), 3) as {label}")


_ISO = "strftime(published_at, '%Y-%m-%dT%H:%M:%S.%f')"

_URLS = """
urls as (
  select event_id, case event_id % 5
      when 0 then 'https://www.youtube.com/watch?v=' || vid
      when 1 then 'https://youtu.be/' || vid
      when 2 then 'https://www.youtube.com/shorts/' || vid
      when 3 then 'https://www.youtube.com/embed/' || vid
      else 'https://www.youtube.com/watch?v=' || vid || '&t=1s' end as url
  from (select event_id, case when event_type = 'error' then substring(lpad(cast(event_id as varchar), 11, '0'), 1, 10)
                             else lpad(cast(event_id as varchar), 11, '0') end as vid from events))"""

_SERVER_RE = r"^.*(?:(?:youtu\.be\/|v\/|vi\/|u\/\w\/|embed\/|shorts\/)|(?:(?:watch)?\?v(?:i)?=|\&v(?:i)?=))([^#\&\?]*).*"
_CLIENT_RE = r"^.*((youtu.be\/)|(v\/)|(\/u\/\w\/)|(embed\/)|(watch\?))\??v?=?([^#&?]*).*"


def _video_id_sql(pattern: str, group: int) -> str:
    ext = f"regexp_extract(url, '{pattern}', {group})"
    return _with(_URLS) + f"""
select event_id, url, case when length({ext}) = 11 then {ext} end as video_id,
       (contains(url, 'youtube.com') or contains(url, 'youtu.be')) as is_video_host
from urls"""


_STATUS = """
status_log as (
  select event_id as seq, event_type as type, 'chat_' || cast(user_id as varchar) as live_chat_id,
         cast(user_id as varchar) as video_id from events)"""


def _page_video_id_sql() -> str:
    ext = f"regexp_extract(url, '{_SERVER_RE}', 1)"
    return f"""
select page_id, url, case when length({ext}) = 11 then {ext} end as video_id,
       (contains(url, 'youtube.com') or contains(url, 'youtu.be')) as is_video_host
from pages"""


SQL: dict[str, str] = {
    "stream_metric_1m": _with() + _stream_metric("minute"),
    "stream_metric_1h": _with() + _stream_metric("hour"),
    "user_metric_1m": _with() + _user_metric_1m(),
    "unique_viewers_exact": _with() + """
select video_id, date_trunc('hour', kafka_timestamp) as window_start,
       date_trunc('hour', kafka_timestamp) + interval 1 hour as window_end,
       count(distinct author_id) as unique_viewers
from comments group by 1, 2, 3""",
    "merge_stream_metric": _with(_STREAM_PARTS_DAY) + _merged_stream(),
    "merge_stream_metric_half_even": _with(_STREAM_PARTS_DAY) + _merged_stream(rnd="round_even"),
    "merge_user_metric": _with(_USER_PARTS_DAY) + _MERGED_USER.format(src="user_parts"),
    "merge_user_metric_merged_scope": _with(_USER_PARTS_DAY) + "select * from (" + _MERGED_USER.format(
        src="user_parts_all") + ") where toxic_count > 0",
    "merge_full_outer": _with(_STREAM_PARTS_DAY) + _merged_stream(),
    "skip_processed_batches": _with() + """
select comment_id, video_id, author_id, author_name, author_image, published_at, kafka_timestamp, toxic_score, batch_id
from comments where batch_id not in (0, 3)""",
    "upsert_comments": _with() + """
select comment_id, video_id, author_id, author_name, author_image, published_at,
       kafka_timestamp + interval 1 hour as kafka_timestamp, toxic_score, batch_id + 7 as batch_id, message
from comments_msg""",
    "change_feed_comment": _with() + f"""
select batch_id, {_FEED_COLS}
from scored_comments where video_id is not null and video_id <> ''""",
    "change_feed_metric": _with(_STREAM_PARTS_DAY) + """
select batch_id, video_id, window_start,
       case when row_number() over w = 1 then 'insert' else 'update' end as op,
       cast(sum(total_comments) over (w rows between unbounded preceding and current row) as bigint) as total_comments,
       cast(sum(toxic_count) over (w rows between unbounded preceding and current row) as bigint) as toxic_count,
       cast(sum(unique_viewers) over (w rows between unbounded preceding and current row) as bigint) as unique_viewers
from stream_parts
where video_id is not null and video_id <> ''
window w as (partition by video_id, window_start order by batch_id)""",
    "author_totals": _with(_USER_1M) + "select video_id, author_id, author_name, author_image, toxic_count from totals",
    "top_toxic_users": _with(_USER_1M) + """
select author_id, author_name, author_image, toxic_count from totals where video_id = 'click'
order by toxic_count desc, author_id limit 5""",
    "top_toxic_users_all": _with(_USER_1M) + "select * from top_all",
    "leaderboard_view": _with(_USER_1M) + """
select video_id, rank, '#' || cast(rank as varchar) as rank_label, author_id, author_name, toxic_count,
       least(toxic_count / coalesce(nullif(max(toxic_count) over (partition by video_id), 0), 1) * 100, 100.0) as share_pct
from top_all""",
    "leaderboard_changes": _with(_USER_1M_PARTS) + """,
d as (select video_id, author_id, batch_id, sum(toxic_count) as delta from user_1m
      where video_id <> '' and author_id <> '' group by 1, 2, 3),
q as (select distinct video_id, batch_id from d),
c as (select q.video_id, q.batch_id, d.author_id, sum(d.delta) as cum
      from q join d on d.video_id = q.video_id and d.batch_id <= q.batch_id group by 1, 2, 3),
r as (select *, row_number() over (partition by video_id, batch_id order by cum desc, author_id) as rn from c),
b as (select video_id, batch_id, string_agg(author_id || ':' || cast(cum as varchar), ',' order by rn) as leaderboard
      from r where rn <= 5 group by 1, 2),
l as (select *, lag(leaderboard) over (partition by video_id order by batch_id) as previous from b)
select video_id, batch_id, leaderboard from l where previous is null or previous <> leaderboard""",
    "enrich_leaderboard": _with(_USER_1M) + """,
authors as (
  select author_id, max_by(author_name, kafka_timestamp) as name, max_by(author_image, kafka_timestamp) as avatar
  from comments group by 1)
select t.video_id, t.rank, t.author_id,
       coalesce(nullif(a.name, ''), 'Unknown') as author_name, coalesce(nullif(a.avatar, ''), '') as author_image,
       t.toxic_count
from top_all t left join authors a on t.author_id = a.author_id""",
    "video_comments": _with() + """
select comment_id, author_name, message, toxic_label, toxic_category, recommended_action, published_at
from scored_comments where video_id = 'click' order by published_at desc, comment_id desc limit 100""",
    "video_comments_all": _with() + """
select video_id, comment_id, author_name, message, toxic_label, toxic_category, recommended_action, published_at
from (select *, row_number() over (partition by video_id order by published_at desc, comment_id desc) as rn
      from scored_comments) where rn <= 100""",
    "recent_windows_all": _with() + """
select video_id, window_start, total_comments, coalesce(toxic_count, 0) as toxic_count, toxic_ratio,
       coalesce(unique_viewers, 0) as unique_viewers
from (select *, row_number() over (partition by video_id order by window_start desc) as rn
      from (""" + _stream_metric("hour") + """)) where rn <= 20""",
    "rolling_feed": _with() + f"""
select {_FEED_COLS}, batch_id from scored_comments where video_id = 'click'
order by batch_id desc, published_at desc, comment_id desc limit 100""",
    "rolling_feed_all": _with() + f"""
select {_FEED_COLS}, batch_id, position from (
  select *, cast(row_number() over (partition by video_id order by batch_id desc, published_at desc, comment_id desc)
                 as integer) as position
  from scored_comments) where position <= 100""",
    "upsert_recent_windows_all": _with(_STREAM_PARTS_HOUR) + """
select video_id, window_start, total_comments, toxic_count, unique_viewers from (
  select video_id, window_start, cast(sum(total_comments) as bigint) as total_comments,
         cast(coalesce(sum(toxic_count), 0) as bigint) as toxic_count,
         cast(coalesce(sum(unique_viewers), 0) as bigint) as unique_viewers,
         row_number() over (partition by video_id order by window_start desc) as rn
  from stream_parts group by 1, 2) where rn <= 20""",
    "feed_view": _with() + """
select comment_id, video_id, author_id, author_name, author_image, message, published_at, toxic_label,
       case when toxic_label = 'Toxic' then toxic_category end as toxic_category,
       case when toxic_label = 'Toxic' then recommended_action end as recommended_action,
       toxic_label = 'Toxic' as is_toxic,
       case when coalesce(author_image, '') = '' then upper(substring(author_name, 1, 2)) end as avatar_text,
       strftime(published_at, '%H:%M') as time_label
from scored_comments where video_id = 'click'""",
    "feed_count": _with() + """
select video_id, count(*) as messages from (
  select video_id, row_number() over (partition by video_id order by batch_id desc, published_at desc, comment_id desc) as position
  from scored_comments) where position <= 100 group by 1""",
    "recent_windows": _with() + """
select video_id, window_start, total_comments, coalesce(toxic_count, 0) as toxic_count, toxic_ratio,
       coalesce(unique_viewers, 0) as unique_viewers
from (""" + _stream_metric("hour") + """) where video_id = 'click' order by window_start desc limit 20""",
    "upsert_recent_windows": _with(_STREAM_PARTS_HOUR) + """
select video_id, window_start, cast(sum(total_comments) as bigint) as total_comments,
       cast(coalesce(sum(toxic_count), 0) as bigint) as toxic_count,
       cast(coalesce(sum(unique_viewers), 0) as bigint) as unique_viewers
from stream_parts where video_id = 'click' group by 1, 2 order by window_start desc limit 20""",
    "latest_status": _with(_STATUS) + """
select video_id, max_by(type, seq) as type, max_by(live_chat_id, seq) as live_chat_id, max(seq) as seq
from (select * from status_log order by seq desc limit 100) group by video_id""",
    "trim_status_log": _with(_STATUS) + "select * from status_log order by seq desc limit 1000",
    "clean_messages": _with(_DOC_CLEAN) + "select doc_id, message_clean from docs_clean",
    "score_comments": _with() + """
select comment_id, toxic, severe_toxic, threat, insult, identity_hate, top_score as toxic_score, toxic_category
from scored_comments""",
    "apply_policy": _with() + """
select comment_id, toxic_score,
       case when toxic_score >= 0.7 then 'Toxic' else 'Not Toxic' end as toxic_label,
       case when toxic_score >= 0.9 then 'Ban' when toxic_score >= 0.7 then 'Hide'
            when toxic_score >= 0.5 then 'Pending' else 'Safe' end as recommended_action
from comments""",
    "score_documents": _with(_DOC_CLEAN) + """,
lex as (select doc_id, """ + ", ".join(_lex_score(l) for l in _LEX) + """ from docs_clean),
top as (select *, greatest(toxic, severe_toxic, threat, insult, identity_hate) as toxic_score from lex)
select doc_id, toxic, severe_toxic, threat, insult, identity_hate, toxic_score,
       coalesce(case when abs(toxic - toxic_score) < 1e-6 then 'toxic' end,
                case when abs(severe_toxic - toxic_score) < 1e-6 then 'severe_toxic' end,
                case when abs(threat - toxic_score) < 1e-6 then 'threat' end,
                case when abs(insult - toxic_score) < 1e-6 then 'insult' end,
                case when abs(identity_hate - toxic_score) < 1e-6 then 'identity_hate' end) as toxic_category,
       case when toxic_score >= 0.7 then 'Toxic' else 'Not Toxic' end as toxic_label,
       case when toxic_score >= 0.9 then 'Ban' when toxic_score >= 0.7 then 'Hide'
            when toxic_score >= 0.5 then 'Pending' else 'Safe' end as recommended_action
from top""",
    "clean_conversations": _with(_TURN_CLEAN) + "select conv_id, turn, message_clean from turns_clean",
    "score_conversations": _with(_TURN_CLEAN) + """,
lex as (select conv_id, turn, """ + ", ".join(_lex_score(l) for l in _LEX) + """ from turns_clean),
top as (select *, greatest(toxic, severe_toxic, threat, insult, identity_hate) as toxic_score from lex)
select conv_id, turn, toxic, severe_toxic, threat, insult, identity_hate, toxic_score,
       coalesce(case when abs(toxic - toxic_score) < 1e-6 then 'toxic' end,
                case when abs(severe_toxic - toxic_score) < 1e-6 then 'severe_toxic' end,
                case when abs(threat - toxic_score) < 1e-6 then 'threat' end,
                case when abs(insult - toxic_score) < 1e-6 then 'insult' end,
                case when abs(identity_hate - toxic_score) < 1e-6 then 'identity_hate' end) as toxic_category,
       case when toxic_score >= 0.7 then 'Toxic' else 'Not Toxic' end as toxic_label,
       case when toxic_score >= 0.9 then 'Ban' when toxic_score >= 0.7 then 'Hide'
            when toxic_score >= 0.5 then 'Pending' else 'Safe' end as recommended_action
from top""",
    "score_logits": _with() + """
select comment_id, (toxic_score - 0.5) * 10 as logit, round(1 / (1 + exp(-((toxic_score - 0.5) * 10))), 3) as score
from comments""",
    "decode_comments": _with() + f"""
select comment_id, video_id, message, author_id, author_image, author_name, {_ISO} as published_at,
       kafka_timestamp, cast(event_id as bigint) as "offset", cast(length(video_id) % 3 as integer) as "partition"
from comments_msg""",
    "snake_case_columns": _with() + f"""
select comment_id, video_id, message, author_id, author_image, author_name, {_ISO} as published_at
from comments_msg""",
    "to_keyed_messages": _with() + f"""
select video_id as key, 'CHAT' as type, comment_id as commentId, video_id as videoId, message,
       author_id as authorId, author_image as authorImage, author_name as authorName, {_ISO} as publishedAt
from comments_msg""",
    "parse_published_at": _with() + """
select comment_id, case when video_id = 'error' then null else published_at end as published_at from comments""",
    "flatten_chat_pages": _with() + f"""
select 'CHAT' as type, comment_id as commentId, video_id as videoId, message, author_id as authorId,
       author_image as authorImage, author_name as authorName, {_ISO} as publishedAt
from comments_msg where video_id <> 'error'""",
    "extract_video_id": _video_id_sql(_SERVER_RE, 1),
    "extract_video_id_client": _video_id_sql(_CLIENT_RE, 7),
    "extract_video_id_pages": _page_video_id_sql(),
}

# Queries made from others: the same comments with lost video ids, decomposed letters, text scores, damaged records
_LOST_VIDEOS = ("event_type as video_id", "case when event_id % 5 <> 0 then event_type end as video_id")
_BOUND = _with() + """
select video_id, count(distinct author_id) as exact_viewers, true as within_bound from comments group by 1"""
_SCORED_TEXT = f"""
text_scores as ({SQL["score_documents"]}),
scored_text as (
  select c.comment_id, c.video_id, c.author_id, c.author_name, c.author_image, c.message, c.published_at, c.kafka_timestamp,
         s.toxic_score, s.toxic_category, s.toxic_label, s.recommended_action
  from comments_msg c join text_scores s on c.event_id % (select count(*) from documents) = s.doc_id)"""

SQL |= {
    "unique_viewers_approx_bound": _BOUND,
    "unique_viewers_merged_bound": _BOUND,
    "merge_full_outer_nulls": SQL["merge_full_outer"].replace(*_LOST_VIDEOS),
    "change_feed_metric_nulls": SQL["change_feed_metric"].replace(*_LOST_VIDEOS),
    "clean_messages_nfd": SQL["clean_messages"],
    "pipeline_comments": _with(_SCORED_TEXT) + """
select comment_id, video_id, author_id, message, published_at, kafka_timestamp, toxic_score, toxic_category, toxic_label,
       recommended_action
from scored_text""",
    "pipeline_stream_metric": _with(_SCORED_TEXT) + _stream_metric("minute").replace("from comments", "from scored_text"),
    "pipeline_user_metric": _with(_SCORED_TEXT) + _user_metric_1m().replace("from comments", "from scored_text"),
    "decode_damaged": _with() + """
select comment_id, case event_id % 11 when 4 then null when 5 then '' else video_id end as video_id, message, author_id,
       case when event_id % 11 <> 6 then published_at end as published_at, kafka_timestamp,
       cast(event_id as bigint) as "offset", cast(length(video_id) % 3 as integer) as "partition"
from comments_msg where event_id % 11 > 3 and message is not null""",
    "decode_rejects": _with() + f"""
select case event_id % 11
         when 0 then '{{"commentId":"' || comment_id || '"'
         when 1 then '{{"type":"CHAT","videoId":"' || video_id || '","authorId":"' || author_id || '","authorImage":"'
                     || author_image || '","authorName":"' || author_name || '","publishedAt":"' || {_ISO} || '"}}' end as raw_value,
       kafka_timestamp, cast(event_id as bigint) as "offset", cast(length(video_id) % 3 as integer) as "partition"
from comments_msg where event_id % 11 < 3""",
}

_LOOKED_UP = "comment_id, video_id, author_id, published_at, top_score as toxic_score"
SQL |= {
    "effective_once_metric": SQL["stream_metric_1h"],
    "first_over_all_batches": SQL["merge_stream_metric"],
    "metric_at_version": _with() + """
select video_id, date_trunc('hour', kafka_timestamp) as window_start, date_trunc('hour', kafka_timestamp) + interval 1 hour as window_end,
       count(comment_id) as total_comments, cast(sum(cast(top_score > 0.7 as bigint)) as bigint) as toxic_count,
       round(sum(cast(top_score > 0.7 as bigint)) / count(comment_id), 3) as toxic_ratio
from scored_comments where batch_id <= 4 group by 1, 2, 3""",
    "live_metric_changes": _with("""
by_version as (
  select case when batch_id <= 2 then 1 when batch_id <= 4 then 2 else 3 end as commit_version, video_id,
         date_trunc('hour', kafka_timestamp) as window_start, count(comment_id) as n, sum(cast(top_score > 0.7 as bigint)) as t
  from scored_comments group by 1, 2, 3)""") + """
select cast(commit_version as bigint) as commit_version, video_id, window_start,
       case when row_number() over w = 1 then 'insert' else 'update' end as op,
       cast(sum(n) over w as bigint) as total_comments, cast(sum(t) over w as bigint) as toxic_count
from by_version window w as (partition by video_id, window_start order by commit_version)""",
    "indexed_ids": _with() + f"""
select {_LOOKED_UP} from scored_comments where event_id in (select max(event_id) from events group by user_id)""",
    "indexed_span": _with() + f"""
select {_LOOKED_UP} from scored_comments
where video_id = 'click' and published_at >= (select max(published_at) from scored_comments) - interval 1 day""",
    "top_toxic_users_two_pass": SQL["top_toxic_users_all"],
    "viewers_any_span": _with("""
seen as (select video_id, author_id, epoch_us(kafka_timestamp) // 60000000 as minute from comments),
spans as (select distinct video_id, minute // 60 * 60 as first, minute // 60 * 60 + ((minute // 60) % 40 + 1) * 17 - 1 as last from seen)""") + """
select s.video_id, first, last, count(distinct author_id) as exact_viewers, true as within_bound
from spans s join seen on seen.video_id = s.video_id and minute between first and last group by 1, 2, 3""",
}
