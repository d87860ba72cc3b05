"""The notice board."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.schema import ROLE_MANAGEMENT, ROLE_TEACHER


def notice_board(notices: DataFrame, users: DataFrame, teachers: DataFrame,
                 management: DataFrame) -> DataFrame:
    """Q8: ``id, title, content, created_at, posted_by``.

    Notices whose poster has no Users row drop out (inner join).  The poster
    is the teacher's or manager's name by role, else the domain id; a
    teacher without a Teachers row shows NULL.
    """
    # Resolve one poster name per posting user first, so the notice texts
    # take part in a single join (and are not carried through three); only
    # users that posted something are looked up.
    posting = notices.select(F.col("posted_by_user_id").alias("user_id")).distinct()
    u = users.select("user_id", "role", "domain_id").join(posting, "user_id", "left_semi")
    t = teachers.select("user_id", F.col("name").alias("t_name"))
    m = management.select("user_id", F.col("name").alias("m_name"))
    poster = (F.when(F.col("role") == ROLE_TEACHER, F.col("t_name"))
               .when(F.col("role") == ROLE_MANAGEMENT, F.col("m_name"))
               .otherwise(F.col("domain_id")))
    posters = (u.join(t, "user_id", "left").join(m, "user_id", "left")
                .select("user_id", poster.alias("posted_by")))
    n = notices.select("notice_id", "title", "content", "created_at",
                       F.col("posted_by_user_id").alias("user_id"))
    return n.join(posters, "user_id").select(F.col("notice_id").alias("id"), "title", "content",
                                             "created_at", "posted_by")
