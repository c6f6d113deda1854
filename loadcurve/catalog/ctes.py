"""Common table expressions of the check SQL (DuckDB dialect), and `sql()` to assemble them."""

from __future__ import annotations

import re

_CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    _CTES[name] = body.strip()


def sql(final: str) -> str:
    """Prefix a statement with the CTEs it names, and those they name."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in _CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(_CTES[name])

    visit(final)
    if not needed:
        return final
    ordered = [f"{n} AS ({_CTES[n]})" for n in _CTES if n in needed]
    body = final.lstrip()
    if body.startswith("WITH "):
        return "WITH " + ",\n".join(ordered) + ",\n" + body.removeprefix("WITH ")
    return "WITH " + ",\n".join(ordered) + "\n" + final


cte("readings", """
SELECT concat('b', user_id) AS building_name, date_trunc('hour', ts) AS full_timestamp,
       CASE WHEN user_id % 2 = 0 THEN 'NSW' ELSE 'LCL' END AS region, sum(value) AS usage_kwh
FROM events GROUP BY 1, 2, 3
""")

cte("weather", """
SELECT date_trunc('hour', ts) AS timestamp_hour,
       avg(CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE)) AS apparent_temperature,
       sum(CASE WHEN event_type = 'error' THEN value ELSE 0 END) AS precipitation,
       CAST(max(CASE WHEN hour(ts) BETWEEN 6 AND 18 THEN 1 ELSE 0 END) AS INTEGER) AS is_day
FROM events GROUP BY 1
""")

cte("weather_norm", """
SELECT timestamp_hour, precipitation, is_day,
       (apparent_temperature - (SELECT min(apparent_temperature) FROM weather))
       / greatest((SELECT max(apparent_temperature) - min(apparent_temperature) FROM weather), 1e-9)
         AS apparent_temperature_norm
FROM weather
""")

# Years of both date columns; the rules of a calendar do not depend on where the years come from.
cte("holiday_years", """
SELECT unnest(range(1990, 2031)) AS y
""")

# Easter by the anonymous Gregorian computus.
cte("easter_parts", """
SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM holiday_years
""")
cte("easter_moon", """
SELECT y, a, b, c, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM easter_parts
""")
cte("easter_week", """
SELECT y, a, h, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM easter_moon
""")
cte("easter_days", """
SELECT y, make_date(y, (h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114) // 31,
                    (h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114) % 31 + 1) AS easter
FROM easter_week
""")
cte("month_days", """
SELECT y, CAST(d AS DATE) AS d, month(d) AS m, day(d) AS dom, isodow(d) AS dow
FROM (SELECT y, unnest(generate_series(make_date(y, 1, 1), make_date(y, 12, 31), INTERVAL 1 DAY)) AS d
      FROM holiday_years)
""")
cte("holidays", """
SELECT DISTINCT calendar, CAST(holiday_date AS DATE) AS holiday_date FROM (
  SELECT c.calendar, d AS holiday_date FROM month_days, (VALUES ('NSW'), ('GB')) c(calendar)
    WHERE (m = 1 AND dom = 1) OR (m = 12 AND dom IN (25, 26))
       OR (m = 1 AND dow = 1 AND dom IN (2, 3))
       OR (m = 12 AND ((dom = 27 AND dow IN (1, 2)) OR (dom = 28 AND dow IN (1, 2))))
  UNION ALL SELECT 'NSW', d FROM month_days
    WHERE (m = 1 AND dom = 26) OR (m = 1 AND dom IN (27, 28) AND dow = 1) OR (m = 4 AND dom = 25)
       OR (m = 6 AND dow = 1 AND dom BETWEEN 8 AND 14) OR (m = 10 AND dow = 1 AND dom <= 7)
       OR d = DATE '2022-09-22'
  UNION ALL SELECT 'NSW', easter + o FROM easter_days, (VALUES (-2), (-1), (0), (1)) v(o)
    WHERE o <> 0 OR y >= 2010
  UNION ALL SELECT 'GB', easter + o FROM easter_days, (VALUES (-2), (1)) v(o)
  UNION ALL SELECT 'GB', d FROM month_days
    WHERE (m = 5 AND dow = 1 AND dom <= 7 AND y NOT IN (1995, 2020))
       OR (m = 5 AND dow = 1 AND dom >= 25 AND y NOT IN (2002, 2012, 2022))
       OR (m = 8 AND dow = 1 AND dom >= 25)
       OR d IN (DATE '1995-05-08', DATE '2020-05-08', DATE '2002-06-04', DATE '2012-06-04',
                DATE '2022-06-02', DATE '1999-12-31', DATE '2002-06-03', DATE '2011-04-29',
                DATE '2012-06-05', DATE '2022-06-03', DATE '2022-09-19', DATE '2023-05-08')
)
""")

cte("unified", """
SELECT r.building_name, r.full_timestamp,
       (r.usage_kwh - (SELECT min(usage_kwh) FROM readings))
       / greatest((SELECT max(usage_kwh) - min(usage_kwh) FROM readings), 1e-9) AS usage_kwh_norm,
       w.apparent_temperature_norm, w.precipitation, w.is_day,
       CAST(isodow(r.full_timestamp) >= 6 AS INTEGER) AS is_weekend,
       CAST(h.holiday_date IS NOT NULL AS INTEGER) AS is_holiday,
       r.region
FROM readings r JOIN weather_norm w ON w.timestamp_hour = r.full_timestamp
LEFT JOIN holidays h ON h.holiday_date = CAST(r.full_timestamp AS DATE)
     AND h.calendar = CASE WHEN r.region = 'NSW' THEN 'NSW' ELSE 'GB' END
""")

cte("scaled", """
SELECT *, (usage_kwh_norm - min(usage_kwh_norm) OVER b)
          / greatest(max(usage_kwh_norm) OVER b - min(usage_kwh_norm) OVER b, 1e-6) AS usage_pb,
       CASE WHEN region = 'LCL' THEN 0 ELSE 1 END AS region_id
FROM unified WINDOW b AS (PARTITION BY region, building_name)
""")

cte("lagged", """
SELECT *, lag(usage_pb, 1) OVER w AS lag_1h, lag(usage_pb, 24) OVER w AS lag_24h,
       CASE WHEN count(usage_pb) OVER d = 24 THEN avg(usage_pb) OVER d END AS rollmean_24h,
       lag(apparent_temperature_norm, 1) OVER w AS temp_lag_1h,
       lag(apparent_temperature_norm, 24) OVER w AS temp_lag_24h,
       lead(usage_pb, 1) OVER w AS y_next
FROM scaled
WINDOW w AS (PARTITION BY region, building_name ORDER BY full_timestamp),
       d AS (PARTITION BY region, building_name ORDER BY full_timestamp
             ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)
""")

cte("features", """
SELECT building_name, full_timestamp, region, region_id, usage_kwh_norm AS usage_kwh_norm_orig, usage_pb,
       apparent_temperature_norm, temp_lag_1h, temp_lag_24h, precipitation, is_day, is_holiday, is_weekend,
       CAST(hour(full_timestamp) AS INTEGER) AS hour,
       CAST(isodow(full_timestamp) - 1 AS INTEGER) AS day_of_week,
       CAST(month(full_timestamp) AS INTEGER) AS month,
       CASE WHEN month(full_timestamp) IN (12, 1, 2) THEN 'Summer'
            WHEN month(full_timestamp) IN (3, 4, 5) THEN 'Autumn'
            WHEN month(full_timestamp) IN (6, 7, 8) THEN 'Winter' ELSE 'Spring' END AS season,
       lag_1h, lag_24h, rollmean_24h, y_next
FROM lagged
WHERE lag_1h IS NOT NULL AND lag_24h IS NOT NULL AND rollmean_24h IS NOT NULL AND y_next IS NOT NULL
""")

cte("preds", """
SELECT region, building_name, full_timestamp, y_next AS y_true, lag_1h AS y_pred FROM features
""")

cte("cutoffs", """
SELECT epoch_ms(0) + to_microseconds(CAST(round(quantile_cont(epoch_us(full_timestamp) / 1e6, 0.8) * 1e6) AS BIGINT)) AS train_end,
       epoch_ms(0) + to_microseconds(CAST(round(quantile_cont(epoch_us(full_timestamp) / 1e6, 0.9) * 1e6) AS BIGINT)) AS val_end
FROM features
""")

cte("split_features", """
SELECT f.*, CASE WHEN full_timestamp <= train_end THEN 'train'
                 WHEN full_timestamp <= val_end THEN 'val' ELSE 'test' END AS split
FROM features f, cutoffs
""")

cte("merged", """
SELECT p.*, f.apparent_temperature_norm, f.precipitation, f.season, f.hour
FROM preds p JOIN features f USING (region, building_name, full_timestamp)
""")

cte("building_mae", """
SELECT region, building_name, avg(abs(y_true - y_pred)) AS mae FROM preds GROUP BY 1, 2
""")
