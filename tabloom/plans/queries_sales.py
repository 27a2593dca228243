"""Sales summaries (P14-P16) on the ``sales`` view of events."""

from __future__ import annotations

from tabloom.operators import profile as P
from tabloom.plans import views as V
from tabloom.plans.registry import query, rounded

_VALID = "WHERE sales > 0 AND customer_count > 0"


@query("sales_totals", """
SELECT round(coalesce(sum(sales), 0), 4) AS total_sales, CAST(coalesce(sum(customer_count), 0) AS BIGINT) AS total_customers,
       CASE WHEN sum(customer_count) > 0 THEN CAST(round_even(sum(sales) / sum(customer_count), 0) AS BIGINT)
            ELSE 0 END AS avg_spend
FROM sales """ + _VALID, ("sales",))
def sales_totals(spark, sf):
    return rounded(P.sales_totals(V.sales(spark, sf)))


@query("sales_by_weekday", """
SELECT dow, round(sum(sales), 4) AS sales, CAST(sum(customer_count) AS BIGINT) AS customers,
       CAST(round_even(sum(sales) / sum(customer_count), 0) AS BIGINT) AS avg_spend,
       row_number() OVER (ORDER BY sum(sales) DESC, dow) AS rank
FROM sales """ + _VALID + """ AND dow IN ('月', '火', '水', '木', '金', '土', '日')
GROUP BY dow""", ("sales",))
def sales_by_weekday(spark, sf):
    return rounded(P.sales_by_weekday(V.sales(spark, sf)))


@query("sales_by_hour_top10", """
SELECT time, round(sum(sales), 4) AS sales, CAST(sum(customer_count) AS BIGINT) AS customers,
       CAST(round_even(sum(sales) / sum(customer_count), 0) AS BIGINT) AS avg_spend,
       row_number() OVER (ORDER BY sum(sales) DESC, time) AS rank
FROM sales """ + _VALID + """ AND time IS NOT NULL
GROUP BY time ORDER BY sum(sales) DESC, time LIMIT 10""", ("sales",))
def sales_by_hour_top10(spark, sf):
    return rounded(P.sales_by_hour(V.sales(spark, sf), top_n=10))
