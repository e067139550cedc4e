"""Queries over nested objects and shown progress; registered with the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import files as S
from ..streaming import emissions as E
from .registry import c, query
from .vehicles import table

#: Objects that forms name: each part's form holds the next ones, some hold images; every tenth chain goes round in a circle.
XOBJECTS = """select p_partkey as parent, p_partkey + 1 as child, case when p_partkey % 6 = 5 then 'Image' else 'Form' end as subtype, cast(case when p_partkey % 4 = 1 then 400 else 1000 end as bigint) as w, cast(p_size * 40 as bigint) as h from part
union all select p_partkey, p_partkey + 2, 'Image', cast(500 as bigint), cast(p_size * 25 as bigint) from part where p_partkey % 11 = 3
union all select p_partkey, p_partkey - p_partkey % 10, 'Form', cast(null as bigint), cast(null as bigint) from part where p_partkey % 10 = 7"""


@query(f"""with recursive x as ({XOBJECTS}), r as (select distinct parent as root, parent as form, 0 as level from x union select r.root, x.child, r.level + 1 from r join x on x.parent = r.form and x.subtype = 'Form' where r.level < 3)
select distinct root from r join x on x.parent = r.form and x.subtype = 'Image' and x.w * x.h >= 300000""")
def nested_scans(spark, sf_dir):
    x = spark.sql(XOBJECTS.replace("from part", "from {p}"), p=table(spark, sf_dir, "part"))
    return S.xobject_scans(x)


@query("""
with recursive e as (select user_id, epoch(ts) as t, cast(1 + event_id % 997 as double) as done, event_type = 'purchase' as force, row_number() over (partition by user_id order by epoch(ts), event_id) as k from events),
f as (
  select user_id, k, t, t as started, t as last, greatest(cast(floor(least(99.0, done / 1000 * 100)) as int), 0) as percent, 0.0 :: double as ema, done, true as told from e where k = 1
  union all
  select e.user_id, e.k, e.t, f.started, case when e.force or e.t - f.last >= 3600 then e.t else f.last end, case when e.force or e.t - f.last >= 3600 then greatest(cast(floor(least(99.0, e.done / 1000 * 100)) as int), f.percent) else f.percent end,
    case when e.force or e.t - f.last >= 3600 then 0.3 * ((e.t - f.started) / e.done) + 0.7 * f.ema else f.ema end, e.done, e.force or e.t - f.last >= 3600
  from f join e on e.user_id = f.user_id and e.k = f.k + 1)
select user_id, round(t, 6) as at, percent, round(ema, 4) as ema, round(case when percent >= 5 then (1000 - done) * ema end, 2) as remaining from f where told""")
def progress_messages(spark, sf_dir):
    t = F.expr("cast(unix_micros(cast(ts as timestamp)) as double) / 1000000.0")
    d = table(spark, sf_dir, "events").select("user_id", "event_id", t.alias("at"), (1 + c("event_id") % 997).cast("double").alias("done"), (c("event_type") == "purchase").alias("force"))
    d = E.emissions(d, "user_id", ["event_id"], 1000.0, 3600.0)
    d = d.withColumn("remaining", F.when(~F.isnan("remaining"), c("remaining")))
    return d.select("user_id", F.round("at", 6).alias("at"), "percent", F.round("ema", 4).alias("ema"), F.round("remaining", 2).alias("remaining"))
