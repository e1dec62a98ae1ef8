"""Pieces of the SQL that independent engines run to check a query."""


def norm(c: str) -> str:
    """Canonical id of column `c`, null where missing."""
    return f"nullif(lower(trim({c}, ' ' || chr(9))), '')"


def secs(c: str) -> str:
    return f"cast(floor(epoch({c})) as bigint)"


CHECKINS = f"checkin_rows as (select seq, {norm('user_id')} user_id, {secs('ts')} t, {norm('item')} item, {norm('cat')} cat, lat, lon from checkins)"

#: Events with account, time and item, as sources.events gives them.
EVENTS = f"""ev as (select seq, {norm('user_id')} user_id, {secs('ts')} t, {norm('item')} item, {norm('cat')} cat, nullif(trim(venue_name, ' ' || chr(9)), '') as name,
    case when isnan(lat) then null else lat end lat, case when isnan(lon) then null else lon end lon
  from checkins where {norm('user_id')} is not null and ts is not null and {norm('item')} is not null)"""

#: Timelines of users with at least 20 events, their cut, and the events after it.
LINES = f"""{EVENTS},
line as (select *, row_number() over (partition by user_id order by t, item, seq) rn, count(*) over (partition by user_id) n from ev),
parts as (select *, n * 4 // 5 cut, rn > n * 4 // 5 held from line where n >= 20),
past as (select distinct user_id, item from parts where not held),
held as (select p.*, q.item is null is_novel from parts p left join past q on p.user_id = q.user_id and p.item = q.item where p.held),
popularity as (select item, count(*) pop from parts where not held group by item)"""

BANDS = f"""{LINES},
ranked as (select i.item, coalesce(pop, 0) pop, row_number() over (order by coalesce(pop, 0), i.item) - 1 rank, count(*) over () n_items
  from (select distinct item from ev) i left join popularity p on i.item = p.item),
bands as (select item, pop, cast(least(19, floor(rank * 20 / n_items)) as int) band, rank, sum(pop + 1) over (order by rank) - (pop + 1) w_from from ranked)"""

#: Fixed value: the first second of 2017.
Y2017 = 1_483_228_800

META = "meta as (select item, arg_max(cat, seq) filter (cat is not null or name is not null) cat0 from ev group by item)"


def hash32(*parts: str) -> str:
    return f"cast('0x' || substr(md5({' || chr(124) || '.join(parts)}), 1, 8) as bigint)"


def uniform(*parts: str) -> str:
    return f"((cast({hash32(*parts)} as double) + 0.5) / 4294967296.0)"


DECISIONS = f"""dec as (select decision_id, {norm('user_id')} user_id, {secs('ts')} t, k, {norm('true_item')} true_item,
    list_transform(candidates, lambda c: {norm('c')}) candidates, answer_idx, list_transform(history, lambda c: {norm('c')}) history from decisions),
opt as (select decision_id, user_id, i - 1 idx, candidates[i] item, coalesce(i - 1 = answer_idx, false) is_true, answer_idx
  from (select *, unnest(generate_series(1, len(candidates))) i from dec where user_id is not null) where candidates[i] is not null)"""

PREDICTIONS = f"""pred as (select p.*, d.user_id from (select * from predictions where answer_idx is not null and logprobs is not null) p
  join (select decision_id, {norm('user_id')} user_id from decisions) d on p.decision_id = d.decision_id where d.user_id is not null)"""
