"""Queries over regression baselines; registered with the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import baseline as X
from ..operators import verdict as D
from ..sources.kept import kept
from .letters import _GIVEN, letters
from .registry import c, query
from .vehicles import sql

_KEY = "concat_ws(':', kind, cast(round_even(x0, 0) as int), cast(round_even(y0, 0) as int), cast(round_even(x1, 0) as int), cast(round_even(y1, 0) as int))"
_BASE = f"bk as (select file_id, page_id, {_KEY} as key, count(*) as n from judged where reason in {V.FRAME_REASONS} and not (x0 = 0 and y0 = 0 and x1 = 0 and y1 = 0) group by all)"
#: What is left of the letters: what the final verdict keeps, some frames that come back, and no file 3.
_STAYS = "file_id <> 3 and (final is null or (7 * page_id + el_ix) % 41 = 0)"


def _judged(spark, sf_dir):
    return kept(D.reasons(letters(spark, sf_dir)))


@query(sql("judged", "@", _GIVEN).replace(" @", f", {_BASE} select file_id, page_id, string_agg(repeat(key || ' ', cast(n as int)), '' order by key) as removed from bk group by file_id, page_id"))
def baseline_inputs(spark, sf_dir):
    d = X.baseline(X.frame_keys(_judged(spark, sf_dir)))
    return d.select("file_id", "page_id", F.concat(F.array_join("removed", " "), F.lit(" ")).alias("removed"))


@query(sql("judged verdict", "@", _GIVEN).replace(" @", f""", {_BASE}, fv as (select j.*, v.reason as final from judged j join verdict v using (file_id, page_id, el_ix)), pk as (select distinct file_id, page_id, {_KEY} as key from fv where {_STAYS})
select file_id, page_id, key, n, 'reappeared' as verdict from bk join pk using (file_id, page_id, key) union all select file_id, null, null, cast(sum(n) as bigint), 'missing' from bk where file_id not in (select file_id from pk) group by file_id"""))
def frames_again(spark, sf_dir):
    judged = _judged(spark, sf_dir)
    back = D.page_loss(judged).select("file_id", "page_id", "rolled_back")
    final = judged.join(back, ["file_id", "page_id"]).withColumn("final", F.when(~c("rolled_back"), c("reason")))
    # as a stored baseline gives the keys
    return X.failures(X.stored_keys(X.baseline(X.frame_keys(judged))), X.present_keys(final.where(_STAYS)))
