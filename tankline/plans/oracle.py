"""The registered queries as SQL that DuckDB runs on the given tables; independent of the operators where it can be."""

from __future__ import annotations

from ..functions import geodesy
from ..operators.routes import CATEGORIES
from ..operators.statistics import ALL_MEASURES, REGISTER_MEASURES
from ..sources.adapters import with_sql
from .queries import SWEEP

_W = "sum({x} * w) / sum(w)"


def _means(low: str = "greatest(mn, 0)", outer: str = "{}") -> str:
    return f"round({_W.format(x='mx')}, 4) AS max, round({_W.format(x='av')}, 4) AS average, round({outer.format(_W.format(x=low))}, 4) AS min, sum(w)::BIGINT AS measurements"


_MATCH = "match AS (SELECT DISTINCT sensor_id, fuel_type, category FROM (SELECT sensor_id, fuel_type, unnest(wiki_hashes) AS hash_id FROM sensors) JOIN wiki USING (hash_id))"
_CAT = f"""cat AS (SELECT category, fuel_type, phenomenon, {_W.format(x='mx')} AS mx, {_W.format(x='av')} AS av, greatest({_W.format(x="CASE WHEN phenomenon IN ('CO2', 'Speed') THEN greatest(mn, 0) ELSE mn END")}, 0) AS mn,
    sum(w) AS w, count(DISTINCT sensor_id) AS n FROM match JOIN stats USING (sensor_id) GROUP BY ALL)"""
_LONG = ", ".join(REGISTER_MEASURES)
_REG = f"""hits AS (SELECT category, year, fuel_type, {_LONG} FROM (SELECT *, unnest(wiki_hashes) AS page FROM cars) JOIN wiki ON page = wiki.hash_id),
    long AS (UNPIVOT hits ON {_LONG} INTO NAME phenomenon VALUE v),
    reg AS (SELECT category, year, fuel_type, phenomenon, avg(v) AS value, count(*) AS numb_cars FROM long WHERE v > 0 GROUP BY ALL)"""
_ALL_LONG = ", ".join(ALL_MEASURES)
_REG_ALL = _REG.replace(_LONG, _ALL_LONG)
_PICK = ", ".join(f"max({c}) FILTER (WHERE phenomenon = '{p}') AS {s}_{n}" for p, s in (("Speed", "sp"), ("Consumption", "cons"), ("CO2", "co2")) for c, n in (("mn", "min"), ("av", "avg"), ("mx", "max")))
_MODEL = f"""model AS (SELECT category, fuel_type, {_PICK}, max(w) FILTER (WHERE phenomenon = 'Speed')::BIGINT AS measurements, max(n) FILTER (WHERE phenomenon = 'Speed') AS sensors_n
    FROM cat WHERE phenomenon IN ('Speed', 'Consumption', 'CO2') GROUP BY ALL HAVING count(DISTINCT phenomenon) >= 3)"""


def _curve(what: str, v: str) -> str:
    s1, s2 = "sp_avg", "sp_max"
    return f"({what}_min * ({v} - {s1}) * ({v} - {s2}) / ({s1} * {s2}) + {what}_avg * {v} * ({v} - {s2}) / ({s1} * ({s1} - {s2})) + {what}_max * {v} * ({v} - {s1}) / ({s2} * ({s2} - {s1})))"


def _growth(what: str, v: str) -> str:
    at, base = f"{_curve(what, v)} / {v}", f"{_curve(what, '63.0')} / 63.0"
    if what == "co2":
        at, base = f"greatest({_curve(what, v)}, 0) / {v}", f"nullif(greatest({_curve(what, '63.0')}, 0), 0) / 63.0"
    else:
        at = f"CASE WHEN {at} <= 0 THEN 1e-8 ELSE {at} END"
    return f"CASE WHEN ({at}) / nullif({base}, 0) >= 0 THEN sqrt(({at}) / nullif({base}, 0)) - 1 END"


_LATEST = """latest AS (SELECT country, max(date) AS date, arg_max(euro_ttc, date) / 1000 AS euro_ttc, arg_max(euro_ht, date) / 1000 AS euro_ht, arg_max(diesel_ttc, date) / 1000 AS diesel_ttc, arg_max(diesel_ht, date) / 1000 AS diesel_ht FROM prices GROUP BY country),
    mean AS (SELECT date, avg(euro_ttc) AS euro_ttc, avg(euro_ht) AS euro_ht, avg(diesel_ttc) AS diesel_ttc, avg(diesel_ht) AS diesel_ht FROM prices GROUP BY date),
    general AS (SELECT date, euro_ttc / 1000 AS euro_ttc, euro_ht / 1000 AS euro_ht, diesel_ttc / 1000 AS diesel_ttc, diesel_ht / 1000 AS diesel_ht FROM mean ORDER BY date DESC LIMIT 1)"""
_LATEST_COLUMNS = ", ".join(f"round({c}, 6) AS {c}" for c in ("euro_ttc", "euro_ht", "diesel_ttc", "diesel_ht"))


def _utm(lon: str, lat: str, zone: str) -> tuple[str, str]:
    """The projection's series written as SQL."""
    off, phi = f"radians({lon} - ({zone} * 6 - 183))", f"radians({lat})"
    ecc = repr(geodesy._ECC)
    t = f"sinh(atanh(sin({phi})) - {ecc} * atanh({ecc} * sin({phi})))"
    xi, eta = f"atan2({t}, cos({off}))", f"atanh(sin({off}) / sqrt(1 + {t} * {t}))"
    k, alpha = repr(geodesy.SCALE * geodesy._RECTIFYING), geodesy._ALPHA
    east = " + ".join([eta, *[f"{a!r} * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, a in enumerate(alpha, 1)]])
    north = " + ".join([xi, *[f"{a!r} * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, a in enumerate(alpha, 1)]])
    return f"(500000 + {k} * ({east}))", f"({k} * ({north}))"


(_E0, _N0), (_E1, _N1) = _utm("x0", "y0", "z"), _utm("x1", "y1", "z")
_SEGS = "segs AS (SELECT a.request_id, a.i AS seg, a.x AS px, a.y AS py, b.x AS qx, b.y AS qy FROM points a JOIN points b ON a.request_id = b.request_id AND b.i = a.i + 1)"
# all lines go up and to the right, so a box is entered at the larger and left at the smaller of two quotients
_PIECES = f"""{_SEGS},
    clipped AS (SELECT request_id, seg, px, py, qx, qy, country, greatest(0, (x0 - px) / (qx - px), (y0 - py) / (qy - py)) AS t0, least(1, (x0 + 10 - px) / (qx - px), (y0 + 10 - py) / (qy - py)) AS t1 FROM segs, countries),
    inside AS (SELECT * FROM clipped WHERE t1 - t0 > 1e-12),
    stops AS (SELECT request_id, seg, px, py, qx, qy, t0, t1 FROM inside UNION ALL SELECT request_id, seg, px, py, qx, qy, 0, 0 FROM segs UNION ALL SELECT request_id, seg, px, py, qx, qy, 1, 1 FROM segs),
    gaps AS (SELECT request_id, seg, px, py, qx, qy, '-' AS country, t1 AS t0, lead(t0) OVER (PARTITION BY request_id, seg ORDER BY t0, t1) AS t1 FROM stops),
    pieces AS (SELECT request_id, country, px + (qx - px) * t0 AS x0, py + (qy - py) * t0 AS y0, px + (qx - px) * t1 AS x1, py + (qy - py) * t1 AS y1
        FROM (SELECT * FROM inside UNION ALL SELECT * FROM gaps WHERE t1 - t0 > 1e-12))"""


def _lengths(source: str, keys: str, out: str) -> str:
    return f"""{out}_zone AS (SELECT *, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS d, floor((sum(sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) * (x0 + x1) / 2) OVER (PARTITION BY {keys}) / sum(sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2)) OVER (PARTITION BY {keys}) + 180) / 6) % 60 + 1 AS z FROM {source}),
    {out} AS (SELECT {keys}, sum(d) AS degrees, sum(sqrt(({_E1} - {_E0}) ** 2 + ({_N1} - {_N0}) ** 2)) AS meters FROM {out}_zone GROUP BY {keys})"""


_CATS = "cats(category, category_en, category_de, tank) AS (VALUES " + ", ".join(str(c) for c in CATEGORIES) + ")"
_REQUESTS = "requests AS (SELECT DISTINCT request_id, CASE WHEN k % 2 = 0 THEN 'gasoline' ELSE 'diesel' END AS fuel_type, CASE WHEN k % 3 = 0 THEN 90.0::DOUBLE ELSE 70.0::DOUBLE END AS v FROM points)"
_PRICED = f"""{_LATEST}, {_PIECES}, {_lengths('pieces', 'request_id, country', 'lengths')},
    parts AS (SELECT l.request_id, l.country, meters / 1000 AS km, (p.country IS NULL)::INT AS late, coalesce(p.date, g.date) AS date, coalesce(p.euro_ttc, g.euro_ttc) AS et, coalesce(p.euro_ht, g.euro_ht) AS eh, coalesce(p.diesel_ttc, g.diesel_ttc) AS dt, coalesce(p.diesel_ht, g.diesel_ht) AS dh
        FROM lengths l LEFT JOIN latest p ON l.country = p.country, general g)"""


def _fold(whole_tanks: bool, keys: str) -> str:
    """The tank's carry-over as a recursion over the numbered parts of todo (keys, n, last_n, km, pt, ph, date, rate, tank)."""
    used, need = "f.rest > 0", "(t.rate * t.km - CASE WHEN f.rest > 0 THEN f.rest ELSE 0 END)"
    rest = f"t.tank * ceil({need} / t.tank) - {need}" if whole_tanks else f"t.tank * round({need} / t.tank, 5) - t.rate * t.km"
    first = "t.rate * t.km"
    first_rest = f"t.tank * ceil({first} / t.tank) - {first}" if whole_tanks else f"t.tank * round({first} / t.tank, 5) - {first}"
    same = " AND ".join(f"t.{k} = f.{k}" for k in keys.split(", "))
    own = ", ".join(f"t.{k}" for k in keys.split(", "))
    return f"""fold AS (SELECT {own}, t.n, t.last_n, greatest({first_rest}, 0) AS rest, t.pt AS bt, t.ph AS bh, t.pt * {first} AS ttc, t.ph * {first} AS ht, {first} AS litres, t.km AS km, t.date FROM todo t WHERE n = 1
        UNION ALL SELECT {own}, t.n, t.last_n, greatest({rest}, 0), CASE WHEN {used} THEN t.pt ELSE f.bt END, CASE WHEN {used} THEN t.ph ELSE f.bh END,
            f.ttc + CASE WHEN {used} THEN f.bt * f.rest ELSE 0 END + t.pt * {need}, f.ht + CASE WHEN {used} THEN f.bh * f.rest ELSE 0 END + t.ph * {need}, f.litres + t.rate * t.km, f.km + t.km, t.date
        FROM fold f JOIN todo t ON {same} AND t.n = f.n + 1),
    done AS (SELECT * FROM fold WHERE n = last_n)"""


def _todo(keys: str, source: str) -> str:
    own = ", ".join(f"s.{k}" for k in keys.split(", "))
    return f"""todo AS (SELECT {own}, row_number() OVER (PARTITION BY {own} ORDER BY late, p.date DESC, p.country) AS n, count(*) OVER (PARTITION BY {own}) AS last_n, p.km, p.date, s.rate, s.tank,
        CASE s.fuel_type WHEN 'gasoline' THEN et ELSE dt END AS pt, CASE s.fuel_type WHEN 'gasoline' THEN eh ELSE dh END AS ph FROM {source} s JOIN parts p USING (request_id))"""


_STAMP = "strftime(done.date, '%Y-%m-%dT%H:%M:%S')"
_MEANS = ", ".join(f"avg(value) FILTER (WHERE phenomenon = '{m}') AS {m}, sum(numb_cars) FILTER (WHERE phenomenon = '{m}') AS n_{m}" for m in REGISTER_MEASURES)
_FULL = " AND ".join(f"{m} IS NOT NULL" for m in REGISTER_MEASURES)
_CO, _NOX, _THC = REGISTER_MEASURES[2:]


def _register_select(head: str, tail: str) -> str:
    out = f"""round(done.km, 6) AS km, round(litres, 2) AS liters, round(ttc, 2) AS w_tax_euro, round(ht, 2) AS wo_tax_euro, {_STAMP} AS price_date, round(rate * 100, 1) AS liter_per_100km,
        round(done.km * co2 / 1000, 6) AS co2_kg, round(co2, 6) AS co2_gram_per_km, round(co2 / rate, 6) AS co2_gram_per_liter"""
    for k in ("co", "nox", "thc"):
        out += f", round(done.km * {k} / 1000, 6) AS {k}_g, round({k}, 6) AS {k}_mg_per_km, round({k} / rate, 6) AS {k}_mg_per_liter"
    return f"SELECT {head}, {out}, CASE WHEN rate IS NULL THEN 'not enough data' END AS calculation_errors {tail}"


def _register_rates(speeds: str) -> str:
    """asked (request_id, category, speed, ...) with its rates, by the register's means and growth factors."""
    return f"""means AS (SELECT category, fuel_type, {_MEANS} FROM reg GROUP BY ALL),
    asked AS (SELECT r.request_id, r.fuel_type, r.v, c.* FROM ({speeds}) r, cats c WHERE c.category <> 'individual'),
    rated AS (SELECT a.*, round_even((n_{_CO} + n_{_NOX} + n_{_THC} + n_co2_g_per_km) / 4, 0)::BIGINT AS cfd_cars, o.sensors_n AS ec_sensors, o.measurements AS ec_measurements,
        CASE WHEN {_FULL} THEN metric_combined / 100 * (1 + {_growth('cons', 'v')}) END AS rate, CASE WHEN {_FULL} THEN co2_g_per_km * (1 + {_growth('co2', 'v')}) END AS co2,
        CASE WHEN {_FULL} THEN {_CO} * (1 + {_growth('cons', 'v')}) END AS co, CASE WHEN {_FULL} THEN {_NOX} * (1 + {_growth('cons', 'v')}) END AS nox, CASE WHEN {_FULL} THEN {_THC} * (1 + {_growth('cons', 'v')}) END AS thc
        FROM asked a LEFT JOIN (means m JOIN model o USING (category, fuel_type)) ON a.category = m.category AND a.fuel_type = m.fuel_type)"""


_ALL = "sensors stats wiki cars countries prices points"
_BRANDLIST = "bl AS (SELECT DISTINCT p_brand AS brand, 'b' || substr(p_brand, 7) AS alias FROM part)"
_REGNAMES = "names AS (SELECT hash_id AS car_id, manufacturer AS brand, model || ' ' || lower(description) AS name, year, description FROM cars)"
_PAGES = "pages_by_name AS (SELECT brand_name AS brand, lower(wiki_name) AS form, hash_id FROM wiki UNION SELECT brand_name, lower(car_name), hash_id FROM wiki)"
_CURATED = "curated AS (SELECT DISTINCT p_brand AS brand, p_name || ' ' || lower(p_type) AS entry, p_brand || ' ' || p_name AS wiki_name FROM part WHERE substr(p_brand, 7)::INT % 2 = 0 AND p_type = 'PROMO')"
_REGMATCH = f"""{_REGNAMES}, {_PAGES}, {_CURATED},
    forms AS (SELECT car_id, brand, 1 AS stage, name AS form FROM names UNION ALL SELECT car_id, brand, 2, name || ' ' || year FROM names UNION ALL SELECT car_id, brand, 3, name || ' ' || description FROM names
        UNION ALL SELECT car_id, brand, 4, name || ' ' || description || ' ' || year FROM names
        UNION ALL SELECT car_id, brand, 4 + len(string_split(name, ' ')) - k, array_to_string(string_split(name, ' ')[1:k], ' ') FROM names, range(1, 8) AS r(k) WHERE k < len(string_split(name, ' '))),
    allhits AS (SELECT car_id, stage, hash_id FROM forms f JOIN pages_by_name p ON f.brand = p.brand AND lower(f.form) = p.form
        UNION SELECT car_id, 0, w.hash_id FROM names n JOIN curated c ON n.brand = c.brand AND (lower(n.name) = lower(c.entry) OR lower(n.name) || n.year = lower(c.entry)) JOIN wiki w ON w.wiki_name = c.wiki_name),
    best AS (SELECT DISTINCT car_id, stage, hash_id FROM allhits QUALIFY stage = min(stage) OVER (PARTITION BY car_id))"""

_NAMES = "names AS (SELECT DISTINCT md5(manufacturer || '|' || model || ' ' || lower(description)) AS car_id, manufacturer AS brand, model || ' ' || lower(description) AS name FROM cars)"


def _own_words(text: str, brand: str) -> str:
    """The distinct words of a text without those of its brand."""
    split = lambda x: f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> '')"
    return f"list_filter(list_distinct({split(text)}), lambda w: NOT list_contains({split(brand)}, w))"


# naive Bayes: how often a word is in the patterns of a tag, for all words of the brand
_BAYES = f"""forms_of AS (SELECT DISTINCT brand_name AS brand, wiki_name AS tag, unnest([wiki_name, car_name, lower(car_name), upper(car_name), array_to_string(list_transform(string_split(lower(car_name), ' '), lambda x: upper(x[1]) || x[2:]), ' ')]) AS pattern FROM wiki),
    learned AS (SELECT brand, tag, pattern, {_own_words('pattern', 'brand')} AS ws FROM forms_of),
    sizes AS (SELECT brand, tag, count(*) AS n FROM learned GROUP BY ALL), totals AS (SELECT brand, sum(n) AS all_n FROM sizes GROUP BY brand),
    seen AS (SELECT brand, tag, word, count(*) AS c FROM (SELECT brand, tag, unnest(ws) AS word FROM learned) GROUP BY ALL), vocabulary AS (SELECT DISTINCT brand, word FROM seen),
    odds AS (SELECT s.brand, s.tag, v.word, (coalesce(c, 0) + 0.1::DOUBLE) / (n + 0.2::DOUBLE) AS p FROM sizes s JOIN vocabulary v USING (brand) LEFT JOIN seen e ON e.brand = s.brand AND e.tag = s.tag AND e.word = v.word),
    base AS (SELECT brand, tag, sum(ln(1 - p)) AS none FROM odds GROUP BY ALL),
    gained AS (SELECT a.brand, a.text, o.tag, sum(ln(o.p / (1 - o.p))) AS gain FROM (SELECT brand, text, unnest(ws) AS word FROM asked) a JOIN odds o USING (brand, word) GROUP BY ALL),
    logits AS (SELECT a.brand, a.text, s.tag, ln(n / all_n) + coalesce(none, 0) + coalesce(gain, 0) AS l FROM asked a JOIN sizes s USING (brand) JOIN totals t USING (brand) LEFT JOIN base b ON b.brand = a.brand AND b.tag = s.tag LEFT JOIN gained g ON g.brand = a.brand AND g.text = a.text AND g.tag = s.tag),
    scored AS (SELECT brand, text, tag, exp(l - max(l) OVER w) / sum(exp(l - m)) OVER w AS score FROM (SELECT *, max(l) OVER (PARTITION BY brand, text) AS m FROM logits) WINDOW w AS (PARTITION BY brand, text)),
    found AS (SELECT * FROM scored WHERE score > 0.25)"""
_STRICT = _REGMATCH + """,
    one AS (SELECT DISTINCT * FROM names), strict AS (SELECT * FROM best WHERE stage <= 1)"""

def _legs(steps: int = 8) -> str:
    """legs: points with m, the metres on the ellipsoid from the point before, by so many steps of the inverse problem."""
    f, a, b = repr(geodesy.FLATTENING), geodesy.A, repr(geodesy.A * (1 - geodesy.FLATTENING))
    u = f"atan((1 - {f}) * tan(radians({{}})))"
    out = [f"""leg0 AS (SELECT *, lam AS turned FROM (SELECT *, sin(u1) AS su1, cos(u1) AS cu1, sin(u2) AS su2, cos(u2) AS cu2, radians(x - px) AS lam FROM (SELECT *, {u.format('py')} AS u1, {u.format('y')} AS u2
        FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM points WINDOW w AS (PARTITION BY request_id ORDER BY i)))))"""]
    arc = """SELECT *, atan2(s, c) AS arc, c - 2 * su1 * su2 / q AS mid FROM (SELECT *, 1 - az * az AS q FROM (SELECT *, cu1 * cu2 * sin(turned) / s AS az
        FROM (SELECT *, sqrt((cu2 * sin(turned)) ** 2 + (cu1 * su2 - su1 * cu2 * cos(turned)) ** 2) AS s, su1 * su2 + cu1 * cu2 * cos(turned) AS c FROM leg{})))"""
    for n in range(steps):
        out.append(f"""leg{n + 1} AS (SELECT * EXCLUDE (turned, s, c, az, q, arc, mid, k), lam + (1 - k) * {f} * az * (arc + k * s * (mid + k * c * (2 * mid * mid - 1))) AS turned
        FROM (SELECT *, {f} / 16 * q * (4 + {f} * (4 - 3 * q)) AS k FROM ({arc.format(n)})))""")
    out.append(f"""legs AS (SELECT *, coalesce({b} * hi * (arc - lo * s * (mid + lo / 4 * (c * (2 * mid * mid - 1) - lo / 6 * mid * (4 * s * s - 3) * (4 * mid * mid - 3)))), 0) AS m
        FROM (SELECT *, 1 + uu / 16384 * (4096 + uu * (-768 + uu * (320 - 175 * uu))) AS hi, uu / 1024 * (256 + uu * (-128 + uu * (74 - 47 * uu))) AS lo
        FROM (SELECT *, q * ({a}::DOUBLE ** 2 - {b} ** 2) / {b} ** 2 AS uu FROM ({arc.format(steps)}))))""")
    return ", ".join(out)


ORACLE_SQL = {
    "avg_vehicle_type": with_sql("sensors stats", f"SELECT sensor_type AS vehicle_type, fuel_type, phenomenon, {_means()}, any_value(k) AS numb_sensors FROM stats JOIN sensors USING (sensor_id) JOIN (SELECT fuel_type, count(*) AS k FROM sensors GROUP BY 1) USING (fuel_type) GROUP BY 1, 2, 3"),
    "avg_manufacturer": with_sql("sensors stats", f"SELECT lower(trim(manufacturer_raw)) AS manufacturer, sensor_type AS vehicle_type, fuel_type, phenomenon, {_means()}, count(DISTINCT sensor_id) AS numb_sensors FROM stats JOIN sensors USING (sensor_id) GROUP BY 1, 2, 3, 4 HAVING sum(w) >= 1500"),
    "avg_category_sensor": with_sql("sensors stats wiki", "SELECT category, fuel_type, phenomenon, round(mx, 4) AS max, round(av, 4) AS average, round(mn, 4) AS min, w::BIGINT AS measurements, n AS numb_sensors FROM cat", f"{_MATCH}, {_CAT}"),
    "avg_category_register": with_sql("cars wiki", "SELECT category, year, fuel_type, phenomenon, round(value, 4) AS value, numb_cars FROM reg", _REG_ALL),
    "category_units": with_sql("phenomena sensors stats wiki", "SELECT phenomenon, category, fuel_type, round(mx, 4) AS max, round(av, 4) AS average, round(mn, 4) AS min, w::BIGINT AS measurements, n AS numb_sensors, unit FROM cat JOIN phenomena ON name = phenomenon", f"{_MATCH}, {_CAT}"),
    "register_measures_long": with_sql("cars", "SELECT phenomenon, fuel_type, count(*) AS n, round(avg(v), 4) AS mean FROM long WHERE v > 0 GROUP BY ALL", f"wide AS (SELECT hash_id, fuel_type, {_ALL_LONG} FROM cars), long AS (UNPIVOT wide ON {_ALL_LONG} INTO NAME phenomenon VALUE v)"),
    "measurement_statistics": "SELECT user_id AS sensor_id, CASE event_type WHEN 'view' THEN 'Speed' WHEN 'click' THEN 'Consumption' WHEN 'purchase' THEN 'CO2' WHEN 'signup' THEN 'Rpm' WHEN 'error' THEN 'Engine Load' END AS phenomenon, max(value) AS max, round(avg(value), 6) AS avg, min(value) AS min, count(*) AS numb_measurements, count(DISTINCT event_id % 997) AS numb_tracks, 1 AS numb_sensors FROM events GROUP BY 1, 2",
    "sensor_fuel_model": with_sql("sensors stats wiki", f"SELECT category, fuel_type, round({_curve('cons', '70.0')}, 4) AS liters_per_hour, round({_curve('co2', '70.0')}, 4) AS co2_kg_per_hour, round({_curve('cons', '70.0')} / 70, 4) AS liters_per_km FROM model", f"{_MATCH}, {_CAT}, {_MODEL}"),
    "register_fuel_model": with_sql("cars wiki", "SELECT category, fuel_type, " + ", ".join(f"round(avg(value) FILTER (WHERE phenomenon = '{m}'), 4) AS {m}, sum(numb_cars) FILTER (WHERE phenomenon = '{m}') AS n_{m}" for m in REGISTER_MEASURES) + " FROM reg WHERE year >= 1995 GROUP BY ALL", _REG),
    "growth_factor": with_sql("sensors stats wiki", f"SELECT category, fuel_type, round({_growth('cons', '90.0')}, 4) AS g_fuel, round({_growth('co2', '90.0')}, 4) AS g_co2 FROM model", f"{_MATCH}, {_CAT}, {_MODEL}"),
    "latest_country_price": with_sql("prices", f"SELECT country, date::VARCHAR AS date, {_LATEST_COLUMNS} FROM latest", _LATEST),
    "first_price_year": with_sql("prices", "SELECT country, year(min(date)) AS first_year FROM prices GROUP BY country"),
    "eu_mean_price": with_sql("prices", "SELECT date::VARCHAR AS date, round(euro_ttc, 4) AS euro_ttc, round(euro_ht, 4) AS euro_ht, round(diesel_ttc, 4) AS diesel_ttc, round(diesel_ht, 4) AS diesel_ht, 1000 AS quantity FROM mean", _LATEST),
    "latest_general_price": with_sql("prices", f"SELECT date::VARCHAR AS date, {_LATEST_COLUMNS} FROM general", _LATEST),
    "merged_price_history": with_sql("prices", "SELECT country, date::VARCHAR AS date, coalesce(CASE WHEN year(date) >= 1997 AND month(date) % 4 <> 0 THEN euro_ttc * 2 END, CASE WHEN year(date) <= 1999 THEN euro_ttc END) AS euro_ttc, euro_ht, diesel_ttc, diesel_ht FROM prices"),
    "merged_tax_sides": with_sql("prices", "SELECT country, date::VARCHAR AS date, CASE WHEN month(date) % 5 <> 0 THEN euro_ttc END AS euro_ttc, CASE WHEN month(date) % 5 <> 0 THEN diesel_ttc END AS diesel_ttc, CASE WHEN month(date) % 7 <> 0 THEN euro_ht END AS euro_ht, CASE WHEN month(date) % 7 <> 0 THEN diesel_ht END AS diesel_ht FROM prices WHERE month(date) % 5 <> 0 OR month(date) % 7 <> 0"),
    "price_block_fill": with_sql("prices", "SELECT substr(country, 2)::INT % 3 AS sheet, country AS code, date::VARCHAR AS date, euro_ttc FROM prices"),
    "foreign_prices": with_sql("prices", "SELECT country, date::VARCHAR AS date, round(CASE WHEN month(date) % 2 = 0 THEN euro_ttc / nullif(year(date) - 1990, 0) ELSE euro_ttc END, 4) AS euro_ttc, round(CASE WHEN month(date) % 2 = 0 THEN diesel_ttc / nullif(year(date) - 1990, 0) ELSE diesel_ttc END, 4) AS diesel_ttc FROM prices"),
    "incremental_prices": with_sql("prices", "SELECT country, date::VARCHAR AS date, euro_ttc, diesel_ttc FROM prices WHERE year(date) >= 1998"),
    "upsert_prices": with_sql("prices", "SELECT country, date::VARCHAR AS date, round(CASE WHEN month(date) = 1 THEN euro_ttc * 2 ELSE euro_ttc END, 4) AS euro_ttc FROM prices"),
    "sensor_match_counts": "SELECT count(*) FILTER (WHERE c_custkey IN (SELECT user_id FROM events)) AS matched, count(*) FILTER (WHERE c_custkey NOT IN (SELECT user_id FROM events)) AS missing FROM customer",
    "sensor_track_rollup": with_sql("sensors tracks", "SELECT sensor_id, any_value(car_model) AS car_model, count(track_id) AS numb_tracks, round(coalesce(sum(track_length), 0), 2) AS total_length FROM sensors LEFT JOIN tracks USING (sensor_id) GROUP BY sensor_id"),
    "track_repair": with_sql("tracks", "SELECT track_id, CASE WHEN fix THEN -sensor_id - 1 ELSE sensor_id END AS sensor_id, round(track_length, 5) AS track_length, fix AS repaired FROM (SELECT *, sensor_id < 0 AND (-sensor_id - 1) % 2 = 0 AND -sensor_id - 1 IN (SELECT c_custkey FROM customer) AS fix FROM tracks)"),
    "fuel_labels": with_sql("sensors", "SELECT fuel_raw, fuel_type, count(*) AS n FROM sensors GROUP BY ALL"),
    "route_length": with_sql("points", "SELECT request_id, round(degrees, 3) AS degrees, round(meters, 3) AS meters FROM whole", f"{_SEGS}, lines AS (SELECT request_id, px AS x0, py AS y0, qx AS x1, qy AS y1 FROM segs), {_lengths('lines', 'request_id', 'whole')}"),
    "route_parts": with_sql("countries points", "SELECT request_id, country, round(degrees, 3) AS degrees, round(meters, 3) AS meters FROM lengths", f"{_PIECES}, {_lengths('pieces', 'request_id, country', 'lengths')}"),
    "point_country": with_sql("countries prices points", "SELECT request_id * 10 + i AS point_id, c.country, date::VARCHAR AS date, round(euro_ttc, 6) AS euro_ttc FROM points JOIN countries c ON x > x0 AND x < x0 + 10 AND y > y0 AND y < y0 + 10 LEFT JOIN latest USING (country)", _LATEST),
    "point_distances": with_sql("points", "SELECT request_id AS route, i AS seq, round(m, 2) AS meters FROM legs", _legs()),
    "route_cost_sensor": with_sql(
        _ALL,
        f"""SELECT r.request_id, r.category, category_en, category_de, r.fuel_type, false AS manual_consumption, sensors_n AS ec_sensors, measurements AS ec_measurements, round(done.km, 6) AS km, round(litres, 3) AS liters,
        round(done.km * co2 / 1000, 6) AS co2_kg, round(ttc, 2) AS w_tax_euro, round(ht, 2) AS wo_tax_euro, {_STAMP} AS price_date, round(rate * 100, 1) AS liter_per_100km, round(co2, 6) AS co2_gram_per_km,
        round(least(co2 / rate, CASE r.fuel_type WHEN 'gasoline' THEN 2392 ELSE 2640 END), 6) AS co2_gram_per_liter, CASE WHEN rate IS NULL THEN 'not enough data' END AS calculation_errors
        FROM rated r JOIN done USING (request_id, category)""",
        f"""{_MATCH}, {_CAT}, {_MODEL}, {_PRICED}, {_CATS}, {_REQUESTS},
        rated AS (SELECT r.request_id, r.fuel_type, c.*, o.sensors_n, o.measurements, {_curve('cons', 'v')} / v AS rate, {_curve('co2', 'v')} / v * 1000 AS co2 FROM requests r JOIN cats c ON c.category <> 'individual' LEFT JOIN model o ON o.category = c.category AND o.fuel_type = r.fuel_type),
        {_todo('request_id, category', 'rated')}, {_fold(True, 'request_id, category')}""",
        recursive=True,
    ),
    "route_cost_register": with_sql(
        _ALL,
        _register_select("r.request_id, r.category, category_en, category_de, r.fuel_type, false AS manual_consumption, cfd_cars, ec_sensors, ec_measurements", "FROM rated r JOIN done USING (request_id, category)"),
        f"{_MATCH}, {_CAT}, {_MODEL}, {_REG}, {_PRICED}, {_CATS}, {_REQUESTS}, {_register_rates('SELECT * FROM requests')}, {_todo('request_id, category', 'rated')}, {_fold(False, 'request_id, category')}",
        recursive=True,
    ),
    "speed_sweep": with_sql(
        _ALL,
        _register_select("r.request_id, r.v::INT AS speed, r.category, category_en, category_de, r.fuel_type, false AS manual_consumption, cfd_cars, ec_sensors, ec_measurements", "FROM rated r JOIN done USING (request_id, category, v)"),
        f"{_MATCH}, {_CAT}, {_MODEL}, {_REG}, {_PRICED}, {_CATS}, {_REQUESTS}, {_register_rates(f'SELECT request_id, fuel_type, s::DOUBLE AS v FROM requests, range({SWEEP[0]}, {SWEEP[1] + 1}, {SWEEP[2]}) AS speeds(s)')}, {_todo('request_id, category, v', 'rated')}, {_fold(False, 'request_id, category, v')}",
        recursive=True,
    ),
    "brands": with_sql("wiki cars sensors", "SELECT DISTINCT trim(b) AS brand FROM (SELECT brand_name AS b FROM wiki UNION SELECT manufacturer FROM cars UNION SELECT manufacturer_raw FROM sensors) WHERE trim(b) <> ''"),
    "cars": with_sql("wiki cars", "SELECT brand, car, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM (SELECT brand_name AS brand, car_name AS car, category FROM wiki UNION SELECT manufacturer, model, category FROM (SELECT manufacturer, model, unnest(wiki_hashes) AS hash_id FROM cars) JOIN wiki USING (hash_id)) GROUP BY ALL"),
    "car_ids": with_sql("cars", """SELECT brand, min(model) AS model, year, description, CASE g WHEN 0 THEN 'description' WHEN 1 THEN 'year' ELSE 'all' END AS level, count(*) AS n, md5(string_agg(hash_id, ',' ORDER BY hash_id)) AS ids_md5
        FROM (SELECT manufacturer AS brand, model, year, description, hash_id, 0 AS g FROM cars WHERE fuel_type IN ('gasoline', 'diesel') UNION ALL SELECT manufacturer, model, year, NULL, hash_id, 1 FROM cars WHERE fuel_type IN ('gasoline', 'diesel')
            UNION ALL SELECT manufacturer, model, NULL, NULL, hash_id, 2 FROM cars WHERE fuel_type IN ('gasoline', 'diesel')) GROUP BY brand, lower(model), year, description, g"""),
    "categories": with_sql("wiki", "SELECT category, category_en, category_de, tank, count(hash_id) AS page_cars FROM cats LEFT JOIN wiki USING (category) GROUP BY ALL", _CATS),
    "match_counts": with_sql("cars", "SELECT count(*) FILTER (WHERE len(wiki_hashes) > 0) AS matched, count(*) FILTER (WHERE coalesce(len(wiki_hashes), 0) = 0) AS unmatched, count(DISTINCT list_sort(wiki_hashes)) AS unique_matches FROM cars"),
    "cars_per_class": with_sql("wiki cars", "SELECT category, count(DISTINCT c.hash_id) AS cars, count(DISTINCT lower(manufacturer)) AS brands, count(DISTINCT page) AS page_cars, count(DISTINCT c.hash_id) FILTER (WHERE fuel_type = 'gasoline') AS gasoline_cars, count(DISTINCT c.hash_id) FILTER (WHERE fuel_type = 'diesel') AS diesel_cars FROM (SELECT *, unnest(wiki_hashes) AS page FROM cars) c JOIN wiki w ON page = w.hash_id GROUP BY category"),
    "cars_per_brand": with_sql("wiki cars", "SELECT manufacturer, cars, gasoline_cars, diesel_cars, categories FROM (SELECT manufacturer, count(*) AS cars, count(*) FILTER (WHERE fuel_type = 'gasoline') AS gasoline_cars, count(*) FILTER (WHERE fuel_type = 'diesel') AS diesel_cars FROM cars GROUP BY 1) LEFT JOIN (SELECT manufacturer, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM (SELECT manufacturer, unnest(wiki_hashes) AS hash_id FROM cars) JOIN wiki USING (hash_id) GROUP BY 1) USING (manufacturer)"),
    "fleet_average": with_sql("sensors stats", """SELECT fuel_type, round(sum(c / s * 100 * cw) FILTER (WHERE floor(c) > 0) / sum(cw) FILTER (WHERE floor(c) > 0 AND s <> 0 AND s IS NOT NULL), 4) AS liter_per_100km, round(sum(o / s * 1000 * ow) FILTER (WHERE floor(o) > 0) / sum(ow) FILTER (WHERE floor(o) > 0 AND s <> 0 AND s IS NOT NULL), 4) AS co2_gram_per_km
        FROM (SELECT sensor_id, max(av) FILTER (WHERE phenomenon = 'Speed') AS s, max(av) FILTER (WHERE phenomenon = 'Consumption') AS c, max(w) FILTER (WHERE phenomenon = 'Consumption') AS cw, max(av) FILTER (WHERE phenomenon = 'CO2') AS o, max(w) FILTER (WHERE phenomenon = 'CO2') AS ow FROM stats GROUP BY 1) JOIN sensors USING (sensor_id)
        WHERE fuel_type IN ('gasoline', 'diesel') GROUP BY fuel_type"""),
    "funnel": with_sql("sensors stats", "SELECT count(*) AS raw, count(*) FILTER (WHERE trim(manufacturer_raw) <> '') AS named, count(*) FILTER (WHERE sensor_id IN (SELECT sensor_id FROM stats)) AS with_statistics, count(*) FILTER (WHERE sensor_id IN (SELECT sensor_id FROM stats WHERE phenomenon IN ('Speed', 'Consumption') GROUP BY 1 HAVING count(*) = 2)) AS usable FROM sensors"),
    "title_to_brand": with_sql("wiki", """SELECT title, CASE WHEN title LIKE 'Brand#11 %' THEN 'Own' ELSE brand END AS brand, CASE WHEN title LIKE 'Brand#11 %' THEN title ELSE car_name END AS model FROM titles WHERE title NOT LIKE 'Brand#2 %'""",
        """titles AS (SELECT DISTINCT CASE WHEN k = 0 THEN 'b' || substr(brand_name, 7) ELSE brand_name END || ' ' || CASE WHEN k = 1 THEN '-' ELSE '' END || car_name AS title, brand_name AS brand, car_name FROM (SELECT *, regexp_extract(hash_id, '[0-9]')::INT % 3 AS k FROM wiki))"""),
    "brand_names": """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN upper(p_brand) WHEN 1 THEN ' b' || substr(p_brand, 7) WHEN 2 THEN '' ELSE p_brand END AS raw, CASE WHEN p_partkey % 4 = 2 THEN '' ELSE p_brand END AS brand FROM part""",
    "year_in_name": with_sql("cars", "SELECT hash_id, CASE WHEN year <= 1999 THEN year WHEN year - 30 >= 1980 THEN year - 30 END AS year FROM cars"),
    "number_parse": """SELECT o_orderkey, raw, CASE WHEN o_orderkey % 4 < 3 THEN round(c / 100, 2) END AS value FROM (SELECT o_orderkey, c, CASE o_orderkey % 4 WHEN 0 THEN (c // 100) || '.' || lpad((c % 100)::VARCHAR, 2, '0') WHEN 1 THEN (c // 100) || ',' || lpad((c % 100)::VARCHAR, 2, '0')
        WHEN 2 THEN CASE WHEN c >= 100000 THEN (c // 100000) || '.' || lpad((c // 100 % 1000)::VARCHAR, 3, '0') ELSE (c // 100)::VARCHAR END || ',' || lpad((c % 100)::VARCHAR, 2, '0') ELSE 'x' END AS raw FROM (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS c FROM orders))""",
    "powerset": """SELECT car_name, string_agg(DISTINCT t, '|' ORDER BY t) AS choices FROM (
            SELECT car_name, unnest(CASE WHEN len(w) = 2 THEN [w[1], w[2], w[1] || ' ' || w[2]] ELSE [w[1]] END) AS t FROM (SELECT car_name, unnest([w, list_transform(w, lambda x: upper(x)), list_transform(w, lambda x: upper(x[1]) || lower(x[2:]))], recursive := false) AS w FROM (SELECT DISTINCT p_name AS car_name, string_split(p_name, ' ') AS w FROM part)))
        GROUP BY car_name""",
    "match_register": with_sql("wiki cars", "SELECT car_id, stage, count(*) AS pages, md5(string_agg(DISTINCT hash_id, ',' ORDER BY hash_id)) AS pages_md5 FROM best GROUP BY ALL", _REGMATCH),
    "review_queue": with_sql("wiki cars", "SELECT n.brand, n.name, count(DISTINCT n.car_id) AS cars, count(hash_id) > 0 AS matched, count(DISTINCT hash_id) AS pages FROM one n LEFT JOIN strict b ON n.car_id = b.car_id GROUP BY ALL", _STRICT),
    "matched_ratio": with_sql("wiki cars", "SELECT round(avg(m), 4) AS matched_ratio FROM (SELECT max((hash_id IS NOT NULL)::INT) AS m FROM one n LEFT JOIN strict b ON n.car_id = b.car_id GROUP BY n.brand, n.name)", _STRICT),
    "match_sensor": with_sql("wiki", "SELECT car_id, stage, count(*) AS pages FROM best GROUP BY ALL", f"""names AS (SELECT p_partkey AS car_id, p_brand AS brand, CASE WHEN p_partkey % 3 = 0 THEN p_brand || ' ' || p_name ELSE upper(p_name) END AS name FROM part), {_PAGES}, {_CURATED},
        forms AS (SELECT car_id, brand, 1 AS stage, lower(name) AS form FROM names UNION SELECT car_id, brand, 2, lower(name) FROM names UNION SELECT car_id, brand, 3, lower(brand || ' ' || name) FROM names),
        allhits AS (SELECT car_id, stage, hash_id FROM forms f JOIN pages_by_name p USING (brand, form) UNION SELECT car_id, 0, w.hash_id FROM names n JOIN curated c ON n.brand = c.brand AND lower(n.name) = lower(c.entry) JOIN wiki w ON w.wiki_name = c.wiki_name),
        best AS (SELECT DISTINCT car_id, stage, hash_id FROM allhits QUALIFY stage = min(stage) OVER (PARTITION BY car_id))"""),
    "clean_model": with_sql("cars", "SELECT hash_id, CASE year % 3 WHEN 0 THEN model || ', ' || year WHEN 1 THEN model || 'MY' || year ELSE model || ', my, x' END AS named, CASE WHEN year % 3 = 2 THEN model || '  x' ELSE model END AS cleaned FROM cars"),
    "keyed_measurements": """SELECT phenomenon, count(*) AS rows, count(DISTINCT h) AS keys, min(h) AS first_key FROM (SELECT p AS phenomenon, md5(event_id || p) AS h FROM (SELECT event_id, CASE event_type WHEN 'view' THEN 'Speed' WHEN 'click' THEN 'Consumption' WHEN 'purchase' THEN 'CO2' WHEN 'signup' THEN 'Rpm' WHEN 'error' THEN 'Engine Load' END AS p FROM events)) GROUP BY 1""",
    "newest_measurement": """SELECT user_id AS sensor_id, event_id AS track_measurement_id, CASE event_type WHEN 'view' THEN 'Speed' WHEN 'click' THEN 'Consumption' WHEN 'purchase' THEN 'CO2' WHEN 'signup' THEN 'Rpm' WHEN 'error' THEN 'Engine Load' END AS phenomenon, value AS phenomenon_value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1""",
    "request_codes": with_sql("points", """SELECT DISTINCT request_id, CASE WHEN request_id % 29 = 9 OR request_id % 19 = 7 THEN 4000 WHEN request_id % 23 = 8 THEN 4002 WHEN request_id % 17 = 6 THEN 4001 WHEN request_id % 5 IN (2, 3) THEN 4009 WHEN request_id % 11 = 4 THEN 4003
        WHEN request_id % 13 = 5 THEN 4005 WHEN request_id % 7 = 1 THEN 4007 END AS error_code, CASE WHEN request_id % 29 <> 9 AND request_id % 23 <> 8 AND request_id % 13 <> 5 THEN 6 END AS points FROM points"""),
}

_CHOICES = "unnest(CASE WHEN len(w) = 1 THEN [w[1]] WHEN len(w) = 2 THEN [w[1], w[2], w[1] || ' ' || w[2]] ELSE [w[1], w[2], w[3], w[1] || ' ' || w[2], w[1] || ' ' || w[3], w[2] || ' ' || w[3], w[1] || ' ' || w[2] || ' ' || w[3]] END)"
_CASES = "unnest([w, list_transform(w, lambda x: lower(x)), list_transform(w, lambda x: upper(x)), list_transform(w, lambda x: upper(x[1]) || lower(x[2:]))], recursive := false)"
_CAR_FACTORS = f"""named AS (SELECT r.request_id, r.fuel_type, r.v, c.* EXCLUDE (fuel_type) FROM requests r JOIN (SELECT DISTINCT l_orderkey AS request_id, md5(l_orderkey || '-' || l_linenumber || '-' || l_partkey) AS hash_id FROM lineitem) i USING (request_id) JOIN cars c ON c.hash_id = i.hash_id AND c.fuel_type = r.fuel_type),
    classes AS (SELECT DISTINCT n.request_id, n.hash_id, n.fuel_type, n.v, w.category FROM (SELECT *, unnest(wiki_hashes) AS page FROM named) n JOIN wiki w ON n.page = w.hash_id),
    factors AS (SELECT request_id, hash_id, avg({_growth('cons', 'v')}) AS g_fuel, avg({_growth('co2', 'v')}) AS g_co2 FROM classes JOIN model USING (category, fuel_type) GROUP BY ALL),
    counted AS (SELECT request_id, sum(n) AS ec_sensors FROM (SELECT request_id, category, max(sensors_n) AS n FROM classes JOIN model USING (category, fuel_type) GROUP BY ALL) GROUP BY 1),
    rated AS (SELECT n.request_id, n.hash_id, n.fuel_type, 40 AS tank, metric_combined / 100 * (1 + g_fuel) AS rate, co2_g_per_km * (1 + g_co2) AS co2, {_CO} * (1 + g_fuel) AS co, {_NOX} * (1 + g_fuel) AS nox, {_THC} * (1 + g_fuel) AS thc FROM named n JOIN factors USING (request_id, hash_id) WHERE {_FULL} AND g_fuel IS NOT NULL)"""
_CAR_OUT = "round(avg(km), 2) AS km, round(avg(litres), 2) AS liters, round(avg(ttc), 2) AS w_tax_euro, round(avg(ht), 2) AS wo_tax_euro, strftime(max(done.date), '%Y-%m-%dT%H:%M:%S') AS price_date, round(avg(rate) * 100, 1) AS liter_per_100km, round(avg(km) * avg(co2) / 1000, 6) AS co2_kg, round(avg(co2), 6) AS co2_gram_per_km, round(avg(co2) / avg(rate), 6) AS co2_gram_per_liter" + "".join(f", round(avg(km) * avg({k}) / 1000, 6) AS {k}_g, round(avg({k}), 6) AS {k}_mg_per_km, round(avg({k}) / avg(rate), 6) AS {k}_mg_per_liter" for k in ("co", "nox", "thc"))
_LINE = "CASE WHEN v < 0 THEN cons_min + v * (cons_avg - cons_min) / sp_avg WHEN v > sp_max THEN cons_avg + (v - sp_avg) * (cons_max - cons_avg) / (sp_max - sp_avg) ELSE " + _curve("cons", "v") + " END"
_EVENTS = "CASE event_type WHEN 'view' THEN 'Speed' WHEN 'click' THEN 'Consumption' WHEN 'purchase' THEN 'CO2' WHEN 'signup' THEN 'Rpm' WHEN 'error' THEN 'Engine Load' END"
_LISTED = "listed AS (SELECT manufacturer AS brand, model, lower(model) AS folded, year, description, hash_id FROM cars WHERE fuel_type IN ('gasoline', 'diesel'))"

ORACLE_SQL |= {
    "route_cost_cars": with_sql(
        _ALL,
        f"SELECT r.request_id, 'individual' AS category, 'Individual' AS category_en, 'Individuell' AS category_de, r.fuel_type, false AS manual_consumption, count(*) AS cfd_cars, any_value(ec_sensors)::BIGINT AS ec_sensors, {_CAR_OUT} FROM rated r JOIN done USING (request_id, hash_id) JOIN counted USING (request_id) GROUP BY r.request_id, r.fuel_type",
        f"{_MATCH}, {_CAT}, {_MODEL}, {_PRICED}, {_REQUESTS}, {_CAR_FACTORS}, {_todo('request_id, hash_id', 'rated')}, {_fold(False, 'request_id, hash_id')}",
        recursive=True,
    ),
    "route_cost_overrides": with_sql(
        _ALL,
        "SELECT r.request_id, r.category, r.category = 'c' AS manual_consumption, round(litres, 3) AS liters, round(ttc, 2) AS w_tax_euro, round(ht, 2) AS wo_tax_euro, round(rate * 100, 1) AS liter_per_100km FROM rated r JOIN done USING (request_id, category)",
        f"""{_MATCH}, {_CAT}, {_MODEL}, {_PRICED}, {_CATS}, {_REQUESTS},
        rated AS (SELECT r.request_id, r.fuel_type, c.category, CASE c.category WHEN 'b' THEN 30 ELSE c.tank END AS tank, coalesce(CASE WHEN c.category = 'c' AND o.measurements IS NOT NULL THEN 7.5 / 100 END, {_curve('cons', '100.0')} / 100) AS rate FROM requests r JOIN cats c ON c.category IN ('b', 'c') LEFT JOIN model o ON o.category = c.category AND o.fuel_type = r.fuel_type),
        {_todo('request_id, category', 'rated')}, {_fold(True, 'request_id, category')}""",
        recursive=True,
    ),
    "route_answer_fields": "SELECT request_id, category, fuel_type, km, liters, w_tax_euro, wo_tax_euro, price_date, liter_per_100km, calculation_errors FROM (" + ORACLE_SQL["route_cost_sensor"] + ")",
    "sensors_per_class": with_sql("sensors stats wiki", """SELECT category, count(DISTINCT sensor_id) AS cars, count(DISTINCT lower(trim(manufacturer_raw))) AS brands, count(DISTINCT hash_id) AS page_cars, count(DISTINCT sensor_id) FILTER (WHERE fuel_type = 'gasoline') AS gasoline_cars, count(DISTINCT sensor_id) FILTER (WHERE fuel_type = 'diesel') AS diesel_cars, any_value(coalesce(m, 0))::BIGINT AS measurements
        FROM (SELECT *, unnest(wiki_hashes) AS hash_id FROM sensors) JOIN wiki USING (hash_id) LEFT JOIN (SELECT category, sum(most) AS m FROM (SELECT DISTINCT sensor_id, category FROM (SELECT sensor_id, unnest(wiki_hashes) AS hash_id FROM sensors) JOIN wiki USING (hash_id)) JOIN (SELECT sensor_id, max(w) AS most FROM stats GROUP BY 1) USING (sensor_id) GROUP BY 1) USING (category) GROUP BY category"""),
    "car_id_counts": with_sql("cars", """SELECT brand, min(model) AS model, year, description, CASE g WHEN 0 THEN 'description' WHEN 1 THEN 'year' ELSE 'all' END AS level, count(*) AS n, min(hash_id) AS first_id, max(hash_id) AS last_id
        FROM (SELECT brand, model, folded, year, description, hash_id, 0 AS g FROM listed UNION ALL SELECT brand, model, folded, year, NULL, hash_id, 1 FROM listed UNION ALL SELECT brand, model, folded, NULL, NULL, hash_id, 2 FROM listed) GROUP BY brand, folded, year, description, g""", _LISTED),
    "car_id_rows": with_sql("cars", "SELECT brand, folded AS model, year, description, hash_id FROM listed", _LISTED),
    "nested_ids": with_sql("cars", "SELECT brand, min(model) AS model, sum(n)::BIGINT AS n, string_agg(year || ':' || n, ',' ORDER BY year) AS by_year FROM (SELECT brand, folded, min(model) AS model, year, count(*) AS n FROM listed GROUP BY brand, folded, year) GROUP BY brand, folded", _LISTED),
    "cars_grouped": with_sql("wiki", "SELECT brand_name, string_agg(car_name || '/' || category, ',' ORDER BY car_name, category) AS cars FROM (SELECT DISTINCT brand_name, car_name, category FROM wiki) GROUP BY 1"),
    "classifier_scores": with_sql("wiki cars", "SELECT brand, text, tag, round(score, 4) AS score FROM found", f"{_NAMES}, asked AS (SELECT brand, name AS text, {_own_words('name', 'brand')} AS ws FROM names), {_BAYES}"),
    "match_register_scored": with_sql(
        "wiki cars",
        "SELECT car_id, stage, count(*) AS pages FROM picked GROUP BY ALL",
        f"""{_REGMATCH.split(", pages_by_name")[0].rstrip().rstrip(",")}, {_CURATED},
        forms AS (SELECT car_id, brand, 1 AS stage, name AS form FROM names UNION ALL SELECT car_id, brand, 2, name || ' ' || year FROM names UNION ALL SELECT car_id, brand, 3, name || ' ' || description FROM names
            UNION ALL SELECT car_id, brand, 4, name || ' ' || description || ' ' || year FROM names
            UNION ALL SELECT car_id, brand, 4 + len(string_split(name, ' ')) - k, array_to_string(string_split(name, ' ')[1:k], ' ') FROM names, range(1, 8) AS r(k) WHERE k < len(string_split(name, ' '))),
        asked AS (SELECT DISTINCT brand, form AS text, {_own_words('form', 'brand')} AS ws FROM forms), {_BAYES},
        listed AS (SELECT DISTINCT n.car_id, w.hash_id FROM names n JOIN curated c ON n.brand = c.brand AND (lower(n.name) = lower(c.entry) OR lower(n.name) || n.year = lower(c.entry)) JOIN wiki w ON w.wiki_name = c.wiki_name),
        hits AS (SELECT DISTINCT car_id, stage, hash_id FROM forms f JOIN found s ON s.brand = f.brand AND s.text = f.form AND s.score >= CASE WHEN stage > 4 THEN 0.99 ELSE 0.4 END JOIN wiki w ON w.wiki_name = s.tag WHERE car_id NOT IN (SELECT car_id FROM listed)),
        picked AS (SELECT car_id, 0 AS stage, hash_id FROM listed UNION ALL SELECT car_id, min(stage) AS stage, hash_id FROM (SELECT * FROM hits QUALIFY stage = min(stage) OVER (PARTITION BY car_id)) GROUP BY car_id, hash_id)""",
    ),
    "accepted_by_score": with_sql(
        "wiki cars",
        "SELECT car_id, rule, count(*) AS pages FROM (SELECT car_id, hash_id, min(rule) AS rule FROM judged JOIN wiki ON wiki_name = tag WHERE rule <= 2 GROUP BY ALL) GROUP BY ALL",
        f"""{_NAMES}, asked AS (SELECT car_id, brand, name, list_distinct(string_split(lower(name), ' ')) AS w FROM names), paged AS (SELECT DISTINCT brand_name AS brand, wiki_name AS tag, list_distinct(string_split(lower(car_name), ' ')) AS pw FROM wiki),
        paired AS (SELECT car_id, a.brand, name, tag, 2 * len(list_intersect(w, pw)) / (len(w) + len(pw)) AS score FROM asked a JOIN paged p ON a.brand = p.brand AND list_has_any(w, pw)),
        judged AS (SELECT car_id, tag, CASE WHEN score >= 0.8 THEN 1 WHEN score >= 0.8::DOUBLE - 0.06::DOUBLE AND list_has_all(regexp_split_to_array(lower(brand || ' ' || name), '[^a-z0-9_]+'), regexp_split_to_array(lower(tag), '[^a-z0-9_]+')) THEN 2 ELSE 9 END AS rule FROM paired)""",
    ),
    "candidate_texts": f"""WITH w AS (SELECT DISTINCT md5(p_brand || '|' || p_name) AS car_id, p_brand AS brand, string_split(p_name, ' ') AS w FROM part), c AS (SELECT car_id, brand, {_CASES} AS w FROM w),
        parts AS (SELECT DISTINCT car_id, brand, {_CHOICES} AS part FROM c), texts AS (SELECT DISTINCT car_id, brand, unnest([brand, 'B' || substr(brand, 7)]) || ' ' || part AS text FROM parts)
        SELECT car_id, brand, count(*) AS texts, min(text) AS first_text, max(text) AS last_text FROM texts GROUP BY ALL""",
    "training_patterns": """WITH own AS (SELECT p_brand AS brand, p_brand || ' ' || p_name AS tag, unnest([p_brand || ' ' || p_name, p_name, lower(p_name), upper(p_name), array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' '), lower(p_type)]) AS pattern FROM part),
        wrong AS (SELECT DISTINCT p_brand AS brand, p_brand || ' ' || p_name AS tag, upper(p_name) AS pattern FROM part WHERE p_partkey % 3 = 0)
        SELECT brand, tag, count(*) AS n, min(pattern) AS first_pattern, max(pattern) AS last_pattern FROM (SELECT DISTINCT * FROM own EXCEPT SELECT * FROM wrong) GROUP BY ALL""",
    "verdict_patterns": f"""WITH w AS (SELECT DISTINCT p_brand AS brand, p_brand || ' ' || p_name AS tag, length(p_name) % 2 = 0 AS ok, list_distinct(string_split(p_name, ' ')) AS w0, string_split(p_name, ' ') AS w FROM part), c AS (SELECT brand, tag, ok, {_CASES} AS w FROM (SELECT brand, tag, ok, list_filter(w, lambda x, i: list_position(w, x) = i) AS w FROM w))
        SELECT brand, tag, CASE WHEN ok THEN 'positive' ELSE 'negative' END AS polarity, count(*) AS n, min(t) AS first_pattern, max(t) AS last_pattern FROM (SELECT DISTINCT brand, tag, ok, {_CHOICES} AS t FROM c) GROUP BY ALL""",
    "match_bridge": with_sql("cars", "SELECT car_id, count(*) AS n, min(md5(car_id || page)) AS first_key FROM (SELECT DISTINCT hash_id AS car_id, unnest(wiki_hashes) AS page FROM cars) GROUP BY 1"),
    "loose_brand_names": """WITH m AS (SELECT DISTINCT p_brand AS brand, substr(p_brand, 7)::INT AS n, 'maker ' || substr(p_brand, 7) || ' works' AS alias FROM part), r AS (SELECT p_partkey, p_brand, CASE p_partkey % 3 WHEN 0 THEN ' maker ' || substr(p_brand, 7, 1) WHEN 1 THEN upper(p_brand) ELSE 'nobody' END AS raw FROM part)
        SELECT p_partkey, raw, CASE p_partkey % 3 WHEN 0 THEN (SELECT arg_min(brand, n) FROM m WHERE contains(alias, trim(raw))) WHEN 1 THEN p_brand ELSE '' END AS brand FROM r""",
    "rewritten_sensors": """SELECT c_custkey AS sensor_id, CASE WHEN lower(c_mktsegment) = 'building' THEN 'Builders' WHEN lower(c_mktsegment) = 'automobile' AND c_custkey % 50 = 7 THEN 'Auto' ELSE c_mktsegment END AS manufacturer,
        CASE WHEN lower(c_mktsegment) = 'automobile' AND c_custkey % 50 = 7 THEN 'Seven' WHEN c_custkey % 50 = 9 THEN 'Nine' ELSE 'model ' || (c_custkey % 50) END AS model FROM customer""",
    "unique_cars": with_sql("cars", "SELECT manufacturer AS brand, lower(model) || CASE WHEN year % 2 = 0 THEN year::VARCHAR ELSE description END AS unique_name, min(hash_id) AS car_id FROM cars GROUP BY 1, 2"),
    "in_word_list": r"""WITH w AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+')) AS word FROM benchmark) WHERE length(word) >= 14), d AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+')) AS word FROM documents) SELECT DISTINCT doc_id FROM d JOIN w USING (word) WHERE word <> ''""",
    "latest_orders": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3",
    "point_prices": with_sql("countries prices points", f"""SELECT route, seq, coalesce(country, '-') AS country, round(m, 2) AS meters, round(coalesce(p.diesel_ttc, g.diesel_ttc), 4) AS price, round(m / 1000 * 0.07 * coalesce(p.diesel_ttc, g.diesel_ttc), 3) AS cost
        FROM (SELECT request_id AS route, i AS seq, c.country, m FROM legs LEFT JOIN countries c ON x > x0 AND x < x0 + 10 AND y > y0 AND y < y0 + 10) LEFT JOIN latest p USING (country), general g""", f"{_LATEST}, {_legs()}"),
    "plain_names": r"""SELECT p_partkey, regexp_replace(raw, '[-()\\"#/@;:<>{}`+=~|.!?,]', ' ', 'g') AS no_marks, trim(replace(regexp_replace(raw, '[(\[].*?[)\]]', '', 'g'), '-', ' ')) AS no_brackets,
        array_to_string(list_filter(string_split(lower(raw), ' '), lambda w, i: list_position(string_split(lower(raw), ' '), w) = i), ' ') AS no_repeats, upper(raw[1]) || lower(raw[2:]) AS capital, raw AS before_comma FROM (SELECT p_partkey, p_name || ' (' || p_type || ')-X/' || p_name AS raw FROM part)""",
    "speed_curves": with_sql("sensors stats wiki", f"SELECT category, fuel_type, v, round({_curve('cons', 'v')}, 4) AS parabola, round({_LINE}, 4) AS linear, printf('%.1f', sign({_LINE}) * floor(abs(round({_LINE}, 6)) * 10) / 10) AS cut, round(least(abs({_LINE}) * 1000, CASE fuel_type WHEN 'gasoline' THEN 2392 WHEN 'diesel' THEN 2640 ELSE 1e300 END), 4) AS capped FROM model, (VALUES (-20.0::DOUBLE), (10.0::DOUBLE), (90.0::DOUBLE), (400.0::DOUBLE)) AS s(v)", f"{_MATCH}, {_CAT}, {_MODEL}"),
    "older_prices": with_sql("countries prices", "SELECT country, date::VARCHAR AS date, 1.0::DOUBLE AS taux, 0.0::DOUBLE AS euro_price, euro_ttc AS euro_super_95, 0.0::DOUBLE AS diesel, 'liter' AS unit, 1000 AS quantity FROM prices JOIN countries USING (country) WHERE month(date) <> 2"),
    "general_sheet": with_sql("prices", "SELECT date::VARCHAR AS date, round(euro_ttc, 4) AS euro_super_95, CASE WHEN month(date) > 6 THEN round(diesel_ttc, 4) ELSE 0 END AS diesel FROM mean", _LATEST),
    "category_members": with_sql("wiki", "SELECT DISTINCT CASE WHEN length(category) = 1 THEN 'Category:' ELSE 'Kategorie:' END || category AS category, CASE WHEN length(category) = 1 THEN 'en' ELSE 'de' END AS page_language, wiki_name AS title FROM wiki"),
    "missing_texts": "SELECT md5(doc_id::VARCHAR) AS hash_id, md5(text) AS text_md5 FROM documents WHERE text IS NOT NULL AND doc_id % 3 <> 0",
    "register_scan": with_sql("cars", "SELECT manufacturer || ' é' AS manufacturer, fuel_type, count(*) AS cars, min(CASE WHEN year BETWEEN 1980 AND 2000 THEN year ELSE year END) AS first_year, " + ", ".join(f"round(avg({m}), 3) AS mean_{m}" for m in ALL_MEASURES) + " FROM cars GROUP BY 1, 2"),
    "boundary_scan": with_sql("countries", "SELECT country, 4 AS edges, x0, y0 + 10 AS y1 FROM countries"),
    "track_page_scan": f"SELECT {_EVENTS} AS phenomenon, count(*) AS n, count(DISTINCT event_id % 997) AS tracks, count(DISTINCT user_id) AS sensors, round(sum(value), 3) AS total, max(ts)::DATE::VARCHAR AS last_day, (SELECT count(*) FROM events) AS points FROM events GROUP BY 1",
    "report_files": with_sql("prices", "SELECT unnest(['csv', 'json']) AS kind, country, date::VARCHAR AS date, euro_ttc FROM prices"),
    "stored_upserts": with_sql("prices", "SELECT country, date::VARCHAR AS date, round(euro_ttc + CASE WHEN month(date) = 3 THEN 1 ELSE 0 END, 3) AS euro_ttc FROM prices"),
    "streamed_statistics": f"SELECT user_id::VARCHAR AS sensor_id, {_EVENTS} AS phenomenon, round(max(value), 3) AS max, round(sum(value), 3) AS sum, round(min(value), 3) AS min, count(value) AS n FROM events GROUP BY 1, 2",
    "loaded_statistics": with_sql("stats", "SELECT md5(sensor_id || phenomenon) AS hash_id, sensor_id, phenomenon, round(mx, 8) AS max, round(av, 8) AS avg, round(greatest(mn, 0), 8) AS min, w AS numb_measurements FROM stats"),
    "loaded_tables": with_sql("tracks wiki cars prices", "SELECT 'track' AS kind, count(*) AS rows, count(DISTINCT track_id) AS keys FROM tracks UNION ALL SELECT 'wiki_car', count(*), count(DISTINCT wiki_name || category) FROM wiki UNION ALL SELECT 'register_car', count(*), count(DISTINCT manufacturer || model || description || coalesce(fuel_type, 'None') || year) FROM cars UNION ALL SELECT 'country_price', count(*), count(DISTINCT country || date) FROM prices"),
    "inserted_prices": with_sql("prices", "SELECT country, date::VARCHAR AS date, euro_ttc FROM prices WHERE month(date) % 2 = 0"),
    "updated_matches": with_sql("cars", "SELECT year, count(*) AS cars, sum(CASE WHEN hash_id IN (SELECT hash_id FROM cars WHERE year % 2 = 0) THEN 1 ELSE 2 END)::BIGINT AS pages FROM cars GROUP BY year"),
    "near_points": with_sql("points", "SELECT request_id AS route, count(*) AS n FROM legs WHERE m / 1000 BETWEEN 0 AND 180 GROUP BY route", _legs()),
}
