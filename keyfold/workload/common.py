"""SQL shared by the oracles: the events table as a change log, and what it accepted."""

LOG = """
    with l as (
      select user_id id, event_id seq, ts,
             case event_type when 'signup' then 'create' when 'error' then 'delete' else 'update' end op,
             event_type in ('signup', 'purchase') sv, event_type in ('signup', 'view') sp, value, props
      from events)"""

ACCEPTED = (
    LOG
    + """,
    h as (select *, max(case when op = 'create' then seq end) over w c,
                 max(case when op = 'delete' then seq end) over w d
          from l window w as (partition by id order by seq
                              rows between unbounded preceding and 1 preceding)),
    a as (select *, (c is not null and (d is null or c > d)) had from h),
    acc as (select * from a where op = 'create' or had)"""
)

IMAGES = (
    ACCEPTED
    + """,
    e as (select *, sum(case when op = 'create' then 1 else 0 end)
                    over (partition by id order by seq rows unbounded preceding) ep from acc),
    k as (select *, max(case when sv then seq end)
                      over (partition by id, ep order by seq rows unbounded preceding) vs,
                    max(case when sp then seq end)
                      over (partition by id, ep order by seq rows unbounded preceding) ps from e),
    n as (select k.id, k.seq, k.ts, k.op, k.had, v.value nv, p.props np from k
          left join l v on v.seq = k.vs left join l p on p.seq = k.ps),
    img as (select id, seq, ts, op,
              case when op = 'delete' then 'REMOVE' when had then 'MODIFY' else 'INSERT' end kind,
              case when had then lag(nv) over (partition by id order by seq) end old_value,
              case when had then lag(np) over (partition by id order by seq) end old_props,
              case when op <> 'delete' then nv end new_value,
              case when op <> 'delete' then np end new_props from n)"""
)
