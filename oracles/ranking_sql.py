"""Oracles of the division ranking."""

from oracles.base import AS_OF, months, r, sql
from oracles import ranking  # noqa: F401

ORACLES = {
    "E1_memberships": sql("SELECT division, competitor, external_rank, seed FROM members"),
    "E2_eligibility": sql("SELECT division, competitor, external_rank, contests, coalesce(div_contests,0) AS div_contests FROM elig"),
    "E3_recency_weight": sql(f"SELECT division, count(*) AS n, {r('sum(pow(0.5::DOUBLE,'+months('date',AS_OF)+'/15))',6)} AS weight FROM contests GROUP BY 1"),
    "E4_schedule_strength": sql(f"SELECT division, competitor, {r('schedule_rating',6)} AS schedule_rating FROM schedule"),
    "E5_metrics_composite": sql(f"SELECT division, competitor, {r('composite',6)} AS composite FROM composite"),
    "E6_pedigree_strength": sql(f"SELECT competitor, wins, losses, contests, top_multiplier, {r('strength',6)} AS strength FROM pedigree"),
    "E8_pedigree_taper": sql(f"SELECT competitor, nth, {r('strength*25*greatest(0,1-nth/6)',6)} AS bonus FROM ctx JOIN pedigree USING (competitor)"),
    "E9_final_rating": sql("SELECT * EXCLUDE (schedule_quality, schedule_strength, schedule_activity) FROM scored"),
    "E10_schedule_activity": sql("SELECT division, competitor, schedule_quality, schedule_strength, schedule_activity FROM scored"),
    "E11_rating_order": sql("SELECT division, pos, competitor, final_rating, schedule_rating FROM ranked"),
    "E12_head_to_head_edges": sql(f"SELECT division, winner, loser, winner_pos, loser_pos, met_on, {r('gap',2)} AS gap FROM edges"),
    "E13_head_to_head_order": sql("SELECT division, pos_h2h, competitor, pos FROM moved"),
    "E14_E15_final_order": sql("SELECT division, rank, competitor, external_rank, loss_streak, is_champion FROM final_rank"),
    "E16_loss_streak": sql("SELECT * FROM streaks"),
    "E17_display_scores": sql("SELECT division, rank, competitor, rank_score, display_score FROM final_rank"),
    "E18_division_rankings": sql("SELECT * EXCLUDE (pos) FROM final_rank"),
    "E19_contender_numbers": sql("SELECT division, rank, competitor, is_champion, contender_rank FROM final_rank"),
    "E20_movement": sql("""SELECT division, competitor, external_rank, coalesce(contender_rank, rank) AS shown_rank,
      CASE WHEN external_rank IS NULL OR external_rank='NR' THEN 'NR' WHEN external_rank='C' THEN NULL
       WHEN external_rank::INT=coalesce(contender_rank, rank) THEN '='
       WHEN external_rank::INT>coalesce(contender_rank, rank) THEN '▲'||(external_rank::INT-coalesce(contender_rank, rank))
       ELSE '▼'||(coalesce(contender_rank, rank)-external_rank::INT) END AS movement FROM final_rank"""),
    "E21_inversions": sql("""SELECT division, count(*) AS ranked, count(*) FILTER (inv) AS inversions FROM (
      SELECT division, final_rating > lag(final_rating) OVER (PARTITION BY division ORDER BY rank) AS inv FROM final_rank) GROUP BY 1"""),
}
