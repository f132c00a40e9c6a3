"""The same answers in SQL, for DuckDB over the same tables."""

from __future__ import annotations

from tallyfold_checks.views import WINDOWS

# What values are counted in for exact sums, and their numbers.
EXACT, COUNTS = "decimal(24,8)", "decimal(12,0)"

VIEWS = {
    "retail": """
        select cast(o_custkey as varchar) as customerid, cast(o_orderdate as timestamp) as invoicedate,
               cast(l_quantity as decimal(18,4)) as quantity,
               cast(p_retailprice as decimal(18,4)) as unitprice, lower(n_name) as country
        from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey
        join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey""",
    "by_supplier": """
        select cast(o_custkey as varchar) as customerid, cast(o_orderdate as timestamp) as invoicedate,
               cast(l_quantity as decimal(18,4)) as quantity,
               cast(p_retailprice as decimal(18,4)) as unitprice, lower(n_name) as country
        from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey
        join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey""",
    "purchases": """
        select cast(user_id as varchar) as customerid, cast(ts as timestamp) as invoicedate,
               cast(1 as decimal(18,4)) as quantity, cast(value as decimal(18,4)) as unitprice
        from events where event_type = 'purchase'""",
    "keyed": """
        select *, cast(o_orderdate as timestamp) + to_minutes(cast((l_orderkey % 24) * 60 + l_orderkey % 60 as integer)) as moment
        from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey
        join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey""",
    "dirty": """
        select cast(l_orderkey as varchar) as "Invoice No", cast(l_partkey as varchar) as "Stock Code",
               case when l_orderkey % 97 = 0 then 'NA' when l_orderkey % 83 = 0 then 'abc'
                    else cast(cast(l_quantity as decimal(18,4)) as varchar) end as "Quantity",
               case when l_orderkey % 2 = 0 then strftime(moment, '%-m/%-d/%Y %-H:%M')
                    else strftime(moment, '%Y-%m-%d %H:%M:%S') end as "Invoice Date",
               cast(cast(p_retailprice as decimal(18,4)) as varchar) as "Unit Price",
               cast(o_custkey as varchar) as "Customer ID",
               case when l_orderkey % 89 = 0 then '' when l_orderkey % 5 = 0 then lower(n_name) else n_name end as "Country"
        from keyed""",
}
NEEDS = {"dirty": ("keyed",)}


def money(expression: str) -> str:
    """An exact decimal sum as a double; four decimals are all it has."""
    return f"cast(cast({expression} as decimal(38,4)) as double)"


def statement(ctes: dict[str, str], select: str, *views: str) -> str:
    wanted: dict[str, str] = {}
    for view in views:
        for name in (*NEEDS.get(view, ()), view):
            wanted[name] = VIEWS[name]
    every = {**wanted, **ctes}
    # one that reads itself cannot be materialised
    kinds = {name: "" if f"from {name} " in sql else "materialized " for name, sql in every.items()}
    body = ",\n".join(f"{name} as {kinds[name]}({sql})" for name, sql in every.items())
    return f"with recursive {body}\n{select}" if body else select


def on(view: str, select: str) -> str:
    return statement({}, select, view)


# Clusters


def quantile(source: str, value: str, share: str) -> str:
    """Interpolated quantile as a subselect, from ranks."""
    return f"""
        (select low + (high - low) * (place - floor(place)) from (
            select max(case when r = floor(p) then v end) as low, max(case when r = ceil(p) then v end) as high,
                   max(p) as place from (
                select cast({value} as double) as v, row_number() over (order by {value}) - 1 as r,
                       {share} * (count(*) over () - 1) as p from {source})))"""


def clusters(
    name: str,
    source: str,
    value: str,
    k: int,
    ascending: bool = True,
    exact: str = EXACT,
    counts: str = COUNTS,
) -> dict[str, str]:
    """Lloyd's iteration until no centre moves; ``{name}`` maps each value to its label."""
    cast = f"cast({value} as {exact})"
    centres = ", ".join(f"c{i}" for i in range(k))
    ctes = {
        f"{name}_hist": f"""
            select {cast} as v, cast({cast} as double) as d, cast(count(*) as {counts}) as w
            from {source} group by all""",
        f"{name}_all": f"select {cast} as v from {source}",
    }
    starts = [
        quantile(f"{name}_all", "v", f"(cast({2 * i + 1} as double) / cast({2 * k} as double))") + f" as c{i}"
        for i in range(k)
    ]

    def bounds(step: str) -> str:
        middles = ", ".join(f"(c{i} + c{i + 1}) / 2 as m{i}" for i in range(k - 1))
        return f"(select *, {middles} from {step})"

    def label() -> str:
        arms = " ".join(f"when d <= m{i} then {i}" for i in range(k - 1))
        return f"case {arms} else {k - 1} end"

    means = ", ".join(
        f"coalesce(cast(sum(case when l = {i} then v * w end) as double) / "
        f"cast(sum(case when l = {i} then w end) as double), any_value(c{i})) as n{i}, any_value(c{i}) as c{i}"
        for i in range(k)
    )
    moved = " or ".join(f"n{i} <> c{i}" for i in range(k))
    ctes[f"{name}_steps"] = f"""
        select 0 as step, true as moves, {", ".join(starts)}
        union all
        select step + 1, {moved}, {", ".join(f"n{i}" for i in range(k))} from (
            select any_value(step) as step, {means} from (
                select v, w, {label()} as l, step, {centres}
                from {name}_hist, {bounds(f"(select * from {name}_steps where moves)")}))
        where step is not null"""
    order = "l" if ascending else "l desc"
    last = f"(select * from {name}_steps where not moves)"
    ctes[name] = (
        f"select v, cast(dense_rank() over (order by {order}) - 1 as integer) as label "
        f"from (select v, {label()} as l from {name}_hist, {bounds(last)})"
    )
    return ctes


def best_clusters(name: str, source: str, value: str, k: int, exact: str = EXACT) -> dict[str, str]:
    """Clusters of least squared error by plain recursion over all distinct values; ``{name}`` as in ``clusters``.

    ``{name}_to{j}``: the largest gain of the first values in j clusters, and where each cluster ends.
    """
    cast = f"cast({value} as {exact})"
    gain = "(b.t - a.t) * (b.t - a.t) / (b.n - a.n)"
    ctes = {
        f"{name}_hist": f"""
            select v, row_number() over (order by v) as i, w,
                   cast(v as double) - (select avg(cast({value} as double)) from {source}) as d
            from (select {cast} as v, cast(count(*) as double) as w from {source} group by all)""",
        f"{name}_sums": f"""
            select i, sum(w) over (order by i) as n, sum(w * d) over (order by i) as t from {name}_hist""",
        f"{name}_to1": f"select i, n, t, t * t / n as g, [i] as ends from {name}_sums",
    }
    for j in range(2, k + 1):
        ctes[f"{name}_to{j}"] = f"""
            select b.i, any_value(b.n) as n, any_value(b.t) as t, max(a.g + {gain}) as g,
                   list_append(arg_max(a.ends, a.g + {gain}), b.i) as ends
            from {name}_to{j - 1} a join {name}_sums b on a.i < b.i group by b.i"""
    ends = f"(select ends from {name}_to{k} order by i desc limit 1)"
    ctes[name] = f"select v, cast(len(list_filter({ends}, lambda e: e < i)) as integer) as label from {name}_hist"
    return ctes


def totals(source: str, keys: str = "customerid") -> str:
    return f"""
        select {keys}, max(invoicedate) as last_purchase, count(invoicedate) as frequency,
               {money('sum(unitprice * quantity)')} as monetary from {source} group by {keys}"""


def metrics(name: str, source: str) -> dict[str, str]:
    return {
        f"{name}_totals": totals(source),
        name: f"""
            select customerid, date_sub('day', last_purchase, (select max(last_purchase) from {name}_totals)) as recency,
                   frequency, monetary from {name}_totals""",
    }


def segments(source: str, profile: str) -> dict[str, str]:
    """CTEs up to ``segments``."""
    ctes = metrics("customers", source)
    if profile == "all_data":
        ctes["users"] = f"""
            select customerid, country, recency, frequency, monetary
            from (select distinct customerid, country from {source}) join customers using (customerid)"""
        keys, mid, high = "customerid, country", 2, 4
    else:
        ctes["users"] = "select * from customers"
        keys, mid, high = "customerid", 2, 5
    ctes.update(clusters("rc", "users", "recency", 4, ascending=profile == "all_data"))
    ctes.update(clusters("fc", "users", "frequency", 4))
    ctes.update(clusters("mc", "users", "monetary", 4))
    ctes["segments"] = f"""
        select {keys}, recency, recency_cluster, frequency, frequency_cluster, monetary, monetary_cluster, overall_score,
               case when overall_score > {high} then 'High-Value' when overall_score > {mid} then 'Mid-Value'
                    else 'Low-Value' end as segment
        from (select *, recency_cluster + frequency_cluster + monetary_cluster as overall_score from (
            select users.*, rc.label as recency_cluster, fc.label as frequency_cluster, mc.label as monetary_cluster
            from users join rc on rc.v = cast(recency as {EXACT})
            join fc on fc.v = cast(frequency as {EXACT})
            join mc on mc.v = cast(monetary as {EXACT})))"""
    return ctes


def _between(start: str, end: str) -> str:
    return f"invoicedate >= timestamp '{start}' and invoicedate < timestamp '{end}'"


SCORED = _between(WINDOWS.rfm_start, WINDOWS.rfm_end)
VALUED = _between(WINDOWS.pred_start, WINDOWS.pred_end)
SLICE = {"scored": f"select * from retail where {SCORED}"}
REVENUE = f"""
    select customerid, {money('sum(unitprice * quantity)')} as future_revenue
    from retail where {VALUED} group by customerid"""
JOINED = {
    **SLICE,
    "revenue": REVENUE,
    "joined": """
        select customerid, coalesce(future_revenue, 0) as future_revenue
        from (select distinct customerid from scored) left join revenue using (customerid)""",
}
WINDOW_SEGMENTS = {**SLICE, **segments("scored", "window")}
VALUES = {
    **WINDOW_SEGMENTS,
    "revenue": REVENUE,
    "joined": """
        select segments.*, coalesce(future_revenue, 0) as future_revenue
        from segments left join revenue using (customerid)""",
    "kept": "select * from joined where future_revenue < " + quantile("joined", "future_revenue", "cast(0.99 as double)"),
    **clusters("vc", "kept", "future_revenue", 3),
    "ltv": f"""
        select kept.*, vc.label as ltv_cluster from kept join vc on vc.v = cast(future_revenue as {EXACT})""",
}
DESCRIBE = " union all ".join(
    f"select ltv_cluster, '{stat}' as stat, round({expression}, 6) as value from ltv group by ltv_cluster"
    for stat, expression in {
        "count": "cast(count(future_revenue) as double)",
        "mean": "avg(future_revenue)",
        "std": "coalesce(stddev_samp(future_revenue), 0)",
        "min": "min(future_revenue)",
        "25%": "quantile_cont(future_revenue, 0.25)",
        "50%": "quantile_cont(future_revenue, 0.5)",
        "75%": "quantile_cont(future_revenue, 0.75)",
        "max": "max(future_revenue)",
    }.items()
)
REPORT = f"""
    select 'rfm_customer_count' as section, 'customerid' as key, '' as stat, cast(count(customerid) as double) as value from segments
    union all select 'rfm_customer_segment_count', segment, '', cast(count(customerid) as double) from segments group by segment
    union all select 'rfm_customer_segment_monetary_value', segment, '', round(cast(sum(cast(monetary as decimal(30,4))) as double), 6) from segments group by segment
    union all select 'prediction_customer_count', cast(ltv_cluster as varchar), '', cast(count(customerid) as double) from ltv group by ltv_cluster
    union all select 'prediction_ltv_revenue', cast(ltv_cluster as varchar), '', round(cast(sum(cast(future_revenue as decimal(30,4))) as double), 6) from ltv group by ltv_cluster
    union all select 'prediction_ltv_description', cast(ltv_cluster as varchar), stat, value from ({DESCRIBE})"""
FLAGS = ", ".join(
    f"cast(segment = '{s}' as integer) as segment_{s.lower().replace('-', '_')}"
    for s in ("Low-Value", "Mid-Value", "High-Value")
)


def in_test(key: str) -> str:
    return f"cast('0x' || substr(md5({key} || '|0'), 1, 8) as bigint) % 100 < 20"


GUESSES = f"select ltv_cluster as label, least(monetary_cluster, 2) as prediction from ltv where {in_test('customerid')}"


def evaluation(pairs: str) -> dict[str, str]:
    return {
        "pairs": pairs,
        "classes": """
            select c, (select count(*) from pairs where label = c) as actual,
                   (select count(*) from pairs where prediction = c) as predicted,
                   (select count(*) from pairs where label = c and prediction = c) as hits
            from (select label as c from pairs union select prediction from pairs)""",
        "rates": """
            select *, coalesce(hits / nullif(predicted, 0), 0) as p, coalesce(hits / nullif(actual, 0), 0) as r from classes""",
        "report": "select *, coalesce(2 * p * r / nullif(p + r, 0), 0) as f from rates",
    }


EVALUATED = """
    select cast(c as varchar) as row, round(p, 6) as precision, round(r, 6) as recall, round(f, 6) as f1,
           cast(actual as bigint) as support from report
    union all select 'accuracy', a, a, a, n from (
        select round(sum(hits) / sum(actual), 6) as a, cast(sum(actual) as bigint) as n from report)
    union all select 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), cast(sum(actual) as bigint) from report
    union all select 'weighted avg', round(sum(p * actual) / sum(actual), 6), round(sum(r * actual) / sum(actual), 6),
           round(sum(f * actual) / sum(actual), 6), cast(sum(actual) as bigint) from report"""


# Monthly figures


def by_month(figure: str, view: str = "retail") -> str:
    return on(view, f"""
        select strftime(date_trunc('month', invoicedate), '%Y-%-m') as month, {figure}
        from {view} group by date_trunc('month', invoicedate)""")


def revenue(condition: str = "true") -> str:
    return f"nullif({money(f'coalesce(sum(case when {condition} then unitprice * quantity end), 0)')}, 0) as revenue"


def metric_clusters(metric: str) -> str:
    ctes = {**metrics("customers", "retail"), **clusters("found", "customers", metric, 4)}
    return statement(ctes, f"""
        select customerid, {metric}, label as {metric}_cluster
        from customers join found on v = cast({metric} as {EXACT})""", "retail")


def points(x: str, y: str, where: str = "true") -> str:
    return statement(segments("retail", "all_data"), f"""
        select cast({x} as double) as x, cast({y} as double) as y, segment,
               case segment when 'Low-Value' then 'red' when 'Mid-Value' then 'blue' else 'green' end as colour
        from segments where {where}""", "retail")


def spine(where: str = "true") -> str:
    return statement(segments("retail", "all_data"), f"""
        select s as segment, (select count(*) from segments where segment = s and {where}) as customers
        from (select unnest(['Low-Value', 'Mid-Value', 'High-Value']) as s)""", "retail")


def on_values(select: str) -> str:
    return statement(VALUES, select, "retail")


def on_window(select: str) -> str:
    return statement(WINDOW_SEGMENTS, select, "retail")


_RAW = ("Stock Code", "Quantity", "Invoice Date", "Unit Price", "Customer ID", "Country")
_NAMED = [f'"{c}" as {c.replace(" ", "").lower()}' for c in ("Invoice No", *_RAW)]
_NULLED = """
    select * replace (nullif("Quantity", 'NA') as "Quantity", nullif("Country", '') as "Country") from dirty"""
_PARSED = """
    case when l_orderkey % 2 = 0 then date_trunc('minute', moment) else moment end"""
_BLANK = """ "Quantity" is null or "Country" is null """
_CLEAN = f"""
    select cast(l_partkey as varchar) as stockcode,
           case when l_orderkey % 83 = 0 then 'abc' else cast(cast(l_quantity as decimal(18,4)) as varchar) end as quantity,
           {_PARSED} as invoicedate, cast(cast(p_retailprice as decimal(18,4)) as varchar) as unitprice,
           cast(o_custkey as varchar) as customerid, lower(n_name) as country
    from keyed where l_orderkey % 97 <> 0 and l_orderkey % 89 <> 0"""
_CLEAN_AMOUNT = "coalesce(try_cast(quantity as decimal(18,4)), 0) * coalesce(try_cast(unitprice as decimal(18,4)), 0)"

ORACLES: dict[str, str] = {
    "scan_csv": on("dirty", 'select * exclude ("Invoice No") replace (nullif("Country", \'\') as "Country") from dirty'),
    "scan_json": on("dirty", "select * from dirty"),
    "scan_json_array": on("dirty", "select * from dirty"),
    "scan_csv_folder": on("dirty", 'select * exclude ("Invoice No") replace (nullif("Country", \'\') as "Country") from dirty'),
    "records_round_trip": on("dirty", "select * from dirty"),
    "scan_csv_quoted": on(
        "dirty",
        """select * exclude ("Invoice No") replace (nullif("Country", '') as "Country"),
          case "Invoice No"::bigint % 3
            when 0 then 'to "' || "Country" || '",' || chr(10) || "Invoice No" || chr(10) || chr(10) || ',x'
            when 1 then 'plain ' || "Invoice No" end as "Note"
        from dirty""",
    ),
    "scan_dispatch": on("dirty", "select * from dirty"),
    "records_json": on("retail", """
        select '{"customerid":"' || customerid || '","invoicedate":"' || strftime(invoicedate, '%Y-%m-%d %H:%M:%S')
               || '","quantity":"' || quantity || '","unitprice":"' || unitprice || '","country":"' || country || '"}' as record
        from retail"""),
    "normalise_missing": on("dirty", _NULLED),
    "drop_incomplete": on("dirty", f"select * from ({_NULLED}) where not ({_BLANK})"),
    "incomplete_rows": on("dirty", f"select * from ({_NULLED}) where {_BLANK}"),
    "lowercase_all": on("dirty", "select " + ", ".join(f'lower("{c}") as "{c}"' for c in ("Invoice No", *_RAW)) + " from dirty"),
    "normalise_names": on("dirty", "select " + ", ".join(_NAMED) + " from dirty"),
    "parse_dates": on("keyed", f"""
        select cast(l_orderkey as varchar) as invoiceno, case when l_orderkey % 101 <> 0 then {_PARSED} end as invoicedate from keyed"""),
    "lenient_numbers": on("dirty", f"""
        select "Invoice No" as invoiceno, cast(coalesce(try_cast("Quantity" as decimal(18,4)), 0) as double) as quantity,
               {money('coalesce(try_cast("Quantity" as decimal(18,4)), 0) * cast("Unit Price" as decimal(18,4))')} as monetary
        from dirty"""),
    "line_value": on("retail", f"select customerid, invoicedate, {money('unitprice * quantity')} as monetary from retail"),
    "clean_transactions": on("keyed", _CLEAN),
    "month_list": on("retail", "select distinct strftime(invoicedate, '%Y-%-m') as month from retail"),
    "country_list": on("retail", """
        select 'All' as name, 'All' as label
        union all select country, upper(substr(country, 1, 1)) || substr(country, 2) from (select distinct country from retail)"""),
    "monthly_revenue": by_month(revenue()),
    "monthly_revenue_lenient": statement({"cleaned": _CLEAN}, f"""
        select strftime(date_trunc('month', invoicedate), '%Y-%-m') as month,
               nullif({money(f'sum({_CLEAN_AMOUNT})')}, 0) as revenue
        from cleaned group by date_trunc('month', invoicedate)""", "keyed"),
    "monthly_revenue_growth": statement({
        "months": f"select date_trunc('month', invoicedate) as m, {revenue()} from retail group by 1",
        "first": "select coalesce(revenue, 1) as base from months order by m limit 1",
    }, """
        select strftime(m, '%Y-%-m') as month, round((revenue - base) / base * 100, 6) as revenue_growth
        from months, first""", "retail"),
    "monthly_quantity": by_month(f"nullif({money('sum(quantity)')}, 0) as quantity"),
    "monthly_customers": by_month("count(distinct customerid) as customers"),
    "monthly_transactions": by_month("count(*) as transactions"),
    "monthly_revenue_country": by_month(revenue("country = 'nation_3'")),
    "monthly_customers_country": by_month("count(distinct case when country = 'nation_3' then customerid end) as customers"),
    "monthly_revenue_fallback": by_month(revenue()),
    "stored_transactions": on("retail", """
        select * replace (cast(quantity as double) as quantity, cast(unitprice as double) as unitprice),
               cast(date_trunc('month', invoicedate) as date) as sale_month from retail"""),
    "monthly_revenue_stored": by_month(revenue("country = 'nation_3'")),
    "monthly_customers_stored": by_month("count(distinct case when country = 'nation_3' then customerid end) as customers"),
    "window_slice_stored": on("retail", f"""
        select * replace (cast(quantity as double) as quantity, cast(unitprice as double) as unitprice) from retail where {SCORED}"""),
    "customers_by_quarter": on("retail", """
        select cast(date_trunc('quarter', invoicedate) as date) as quarter, count(distinct customerid) as customers, true as near
        from retail group by 1"""),
    "clean_counts": on("dirty", """
        select name, lines::bigint as lines from (
            select count(*) as "rows", count(*) filter ("Quantity" = 'NA' or "Country" = '') as dropped,
                   count(*) filter ("Quantity" = 'NA') as "token:quantity", count(*) filter ("Country" = '') as "blank:country" from dirty)
        unpivot (lines for name in ("rows", dropped, "token:quantity", "blank:country")) where lines > 0"""),
    "clean_rejected": on("dirty", """
        select "Invoice No" as invoiceno, "Stock Code" as stockcode, "Quantity" as quantity, "Country" as country,
               concat_ws(',', case when "Quantity" = 'NA' then 'token:quantity' end, case when "Country" = '' then 'blank:country' end) as missing
        from dirty"""),
    "last_purchase": on("retail", "select customerid, max(invoicedate) as last_purchase from retail group by 1"),
    "recency": statement(metrics("customers", "retail"), "select customerid, recency from customers", "retail"),
    "recency_purchases": statement(metrics("customers", "purchases"), "select customerid, recency from customers", "purchases"),
    "frequency": on("retail", "select customerid, count(invoicedate) as frequency from retail group by 1"),
    "monetary": on("retail", f"select customerid, {money('sum(unitprice * quantity)')} as monetary from retail group by 1"),
    "distinct_customers": on("retail", "select distinct customerid from retail"),
    "customer_countries": on("by_supplier", "select distinct customerid, country from by_supplier"),
    "rfm_metrics": statement(metrics("customers", "retail"), "select * from customers", "retail"),
    "rfm_by_country": statement(metrics("customers", "by_supplier"), """
        select customerid, country, recency, frequency, monetary
        from (select distinct customerid, country from by_supplier) join customers using (customerid)""", "by_supplier"),
    "recency_clusters": metric_clusters("recency"),
    "frequency_clusters": metric_clusters("frequency"),
    "monetary_clusters": metric_clusters("monetary"),
    "order_cluster": """
        with ranks as (
            select l_suppkey % 7 as old, cast(row_number() over (order by avg(l_extendedprice) desc) - 1 as integer) as label
            from lineitem group by 1)
        select l_orderkey, l_linenumber, l_extendedprice, label from lineitem join ranks on l_suppkey % 7 = old""",
    "rfm_segments": statement(segments("retail", "all_data"), "select * from segments", "retail"),
    "rfm_segments_many_countries": statement(segments("by_supplier", "all_data"), "select * from segments", "by_supplier"),
    "segment_counts": spine(),
    "segment_counts_country": spine("country = 'nation_3'"),
    "scatter_rvsm": points("recency", "monetary"),
    "scatter_thinned": statement(segments("retail", "all_data"), """
        select x, y, segment, case segment when 'Low-Value' then 'red' when 'Mid-Value' then 'blue' else 'green' end as colour
        from (
            select *, row_number() over (partition by segment, cell_x, cell_y, lot order by digest, x, y) as place from (
                select x, y, segment, digest, ('0x' || substr(digest, 1, 7))::bigint % 3 as lot,
                       coalesce(least(floor((x - min(x) over ()) / nullif(max(x) over () - min(x) over (), 0) * 20), 19), 0) as cell_x,
                       coalesce(least(floor((y - min(y) over ()) / nullif(max(y) over () - min(y) over (), 0) * 20), 19), 0) as cell_y
                from (select cast(recency as double) as x, cast(monetary as double) as y, segment, md5(customerid) as digest from segments)))
        where place = 1""", "retail"),
    "scatter_rvsf": points("recency", "frequency", "country = 'nation_3'"),
    "scatter_fvsm": points("frequency", "monetary"),
    "window_slice": on("retail", f"""
        select * replace (cast(quantity as double) as quantity, cast(unitprice as double) as unitprice) from retail where {SCORED}"""),
    "window_segments": on_window("select * from segments"),
    "window_customer_count": statement(SLICE, "select count(distinct customerid) as customerid from scored", "retail"),
    "window_segment_counts": on_window("select segment, count(customerid) as customers from segments group by 1"),
    "window_segment_value": on_window("select segment, round(cast(sum(cast(monetary as decimal(30,4))) as double), 6) as monetary from segments group by 1"),
    "score_profile": on_window("""
        select overall_score, round(avg(recency), 6) as mean_recency, round(avg(frequency), 6) as mean_frequency,
               round(avg(monetary), 6) as mean_monetary from segments group by 1"""),
    "future_revenue": on("retail", REVENUE),
    "future_revenue_joined": statement(JOINED, "select * from joined", "retail"),
    "revenue_p99": statement(JOINED, "select round(quantile_cont(future_revenue, 0.99), 6) as p99 from joined", "retail"),
    "outlier_trim": statement(JOINED, """
        select * from joined where future_revenue < (select quantile_cont(future_revenue, 0.99) from joined)""", "retail"),
    "ltv_clusters": on_values("select * from ltv"),
    "ltv_describe": on_values(DESCRIBE),
    "ltv_counts": on_values("select ltv_cluster, count(customerid) as customers from ltv group by 1"),
    "ltv_revenue": on_values("select ltv_cluster, round(cast(sum(cast(future_revenue as decimal(30,4))) as double), 6) as future_revenue from ltv group by 1"),
    "class_balance": on_values("""
        select ltv_cluster, round(count(*) / sum(count(*)) over (), 6) as share from ltv group by 1"""),
    "value_report": on_values(REPORT),
    "ltv_summaries": on_values(f"select * from ({REPORT}) where section like 'prediction%'"),
    "segment_onehot": on_window(f"select customerid, {FLAGS} from segments"),
    "ltv_features": on_values(f"select * exclude (segment, future_revenue), {FLAGS} from ltv"),
    "train_test_split": f"select cast(c_custkey as varchar) as customerid, {in_test('cast(c_custkey as varchar)')} as is_test from customer",
    "accuracy": on_values(f"select round(avg(case when label = prediction then 1.0 else 0 end), 6) as accuracy from ({GUESSES})"),
    "classification_report": statement({**VALUES, **evaluation(GUESSES)}, EVALUATED, "retail"),
    "classification_report_lines": statement(evaluation("""
        select case l_returnflag when 'A' then 0 when 'N' then 1 when 'R' then 2 else 3 end as label,
               case when l_linestatus = 'F' then 0 when l_quantity > 25 then 1 else 4 end as prediction from lineitem"""), EVALUATED),
}


# Columns that need many steps, many decimals, many digits or many groups

_FINE = "select event_id, event_type, value / 1000000 as x from events"
_INVERSE = """
    select l_orderkey, l_linenumber, 1000000000000 // (1 + (l_orderkey * 8 + l_linenumber) * 2654435761 % 1000003) as x
    from lineitem"""
ORACLES |= {
    "skewed_clusters": statement({"inverse": _INVERSE, **clusters("found", "inverse", "x", 12)}, f"""
        select l_orderkey, l_linenumber, label from inverse join found on v = cast(x as {EXACT})"""),
    "fine_clusters": statement({"fine": _FINE, **clusters("found", "fine", "x", 4, exact="decimal(24,18)")}, """
        select event_id, label from fine join found on v = cast(x as decimal(24,18))"""),
    "fine_quantiles": statement({"fine": _FINE}, " union all ".join(
        f"select cast({p} as double) as probability, round(quantile_cont(x, {p}), 12) as value from fine" for p in (0.25, 0.5, 0.99))),
    "fine_trim": statement({"fine": _FINE}, "select event_id from fine where x < (select quantile_cont(x, 0.99) from fine)"),
    "quantiles_by_customer": "select user_id, 0.5::double as probability, quantile_cont(value, 0.5) as value from events where user_id is not null group by user_id",
    "approximate_quantiles": """
        select event_type, probability, true as near
        from (select distinct event_type from events where event_type is not null and value is not null),
             (select unnest([0.1, 0.5, 0.99])::double as probability)""",
    "merged_quantiles": """
        select l_returnflag, probability, true as near
        from (select distinct l_returnflag from lineitem), (select unnest([0.25, 0.5, 0.75, 0.99])::double as probability)""",
    "approximate_describe": on_values(f"""
        select ltv_cluster, stat, case when not ends_with(stat, '%') then value end as value,
               case when ends_with(stat, '%') then true end as inside from ({DESCRIBE})"""),
    "lenient_extremes": """
        select l_orderkey, l_linenumber,
               case when l_orderkey % 3 = 0 then 1e15::double when l_orderkey % 3 = 1 then 0 else l_quantity::double end as quantity,
               case when l_linenumber % 2 = 0 then 0.00004::double else 2.5 end as unitprice
        from lineitem""",
}

# Clusters of least squared error

_BEST_MONEY = {**metrics("customers", "retail"), **best_clusters("found", "customers", "monetary", 4)}
ORACLES |= {
    "monetary_clusters_optimal": statement(_BEST_MONEY, f"""
        select customerid, monetary, label as monetary_cluster
        from customers join found on v = cast(monetary as {EXACT})""", "retail"),
    "quantity_clusters_optimal": statement(best_clusters("found", "lineitem", "l_quantity", 4), f"""
        select l_orderkey, l_linenumber, 3 - label as label from lineitem join found on v = cast(l_quantity as {EXACT})"""),
    "default_clusters_gap": statement(_BEST_MONEY, f"""
        select round(sum(part) / any_value(whole), 6) as least_within, true as default_near from (
            select var_pop(monetary) * count(*) as part,
                   (select var_pop(monetary) * count(*) from customers) as whole
            from customers join found on v = cast(monetary as {EXACT}) group by label)""", "retail"),
}

# What is certain about trained models

ORACLES |= {
    "ltv_predictions_known": on_values(f"""
        select customerid, {in_test('customerid')} as is_test, ltv_cluster as label, true as known from ltv"""),
    "ltv_predictions_fit": on_values(f"""
        select cast(sum(n) as bigint) as train_rows, max(n) as largest_class, true as fits
        from (select count(*) as n from ltv where not ({in_test('customerid')}) group by ltv_cluster)"""),
    "cluster_spread_ml": statement(
        {**metrics("customers", "retail"), **clusters("found", "customers", "monetary", 4)},
        f"""
        select round(sum(part) / any_value(whole), 6) as left_within, true as ml_close from (
            select var_pop(monetary) * count(*) as part,
                   (select var_pop(monetary) * count(*) from customers) as whole
            from customers join found on v = cast(monetary as {EXACT}) group by label)""",
        "retail",
    ),
}
