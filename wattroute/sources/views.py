"""The driver's tables and the domain views over them. The same SQL text runs in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_TABLES = {"v_node": ["part"], "v_edge": ["part"], "v_way": ["part"], "v_charger": ["supplier", "nation", "region"], "v_fix": ["events"], "v_trip": ["events"], "v_payload": ["events"], "v_line": ["events"]}

SQL = {
    "v_node": "select p_partkey node_id, cast(48 as double)+cast(p_partkey % 40 as double)*cast(0.005 as double) lat, cast(5 as double)+cast(floor(p_partkey/40) as double)*cast(0.007 as double) lon from part",
    "v_edge": "select a.p_partkey src, b.p_partkey dst, cast(500+(a.p_partkey*131+b.p_partkey*17)%1500 as double) length_m, cast(30+a.p_size*2 as double) speed_kmh, cast(a.p_partkey*7%20 as double) ascent_m, cast(b.p_partkey*11%20 as double) descent_m, case when a.p_type='ECONOMY' then 1 else 0 end road_class from part a join (select 1 d union all select -1 union all select 40 union all select -40) k on 1=1 join part b on b.p_partkey=a.p_partkey+k.d where not (a.p_partkey%20=0 and k.d<0) and not (k.d=1 and a.p_partkey%40=39) and not (k.d=-1 and a.p_partkey%40=0)",
    "v_way": "select p_partkey way_id, case p_type when 'ECONOMY' then 'residential' when 'SMALL' then 'tertiary' when 'MEDIUM' then 'secondary' when 'PROMO' then 'primary' when 'STANDARD' then 'footway' else 'motorway_link' end highway, case when p_size%3=0 then cast(p_size*2 as string) when p_size%3=1 then concat(cast(p_size as string),' mph') else null end maxspeed, case when p_partkey%5=0 then 'yes' when p_partkey%7=0 then '-1' else null end oneway, case when p_partkey%11=0 then 'roundabout' when p_partkey%13=0 then 'circular' else null end junction, p_brand name from part",
    "v_charger": "select concat('sup:',cast(s_suppkey as string)) id, s_name name, cast(48 as double)+cast(s_suppkey*37%200 as double)*cast(0.001 as double) lat, cast(5 as double)+cast(s_suppkey*53%350 as double)*cast(0.001 as double) lon, n_name operator, r_name country, cast(case s_suppkey%8 when 0 then 22 when 1 then 50 when 2 then 62.5 when 3 then 150 when 4 then 160 when 5 then 175 when 6 then 300 else 396 end as double) max_power_kw from supplier join nation on s_nationkey=n_nationkey join region on n_regionkey=r_regionkey",
    "v_fix": "select user_id trip_id, cast(row_number() over(partition by user_id order by ts,event_id)-1 as bigint) seq, cast((row_number() over(partition by user_id order by ts,event_id)-1)*10 as double) t_s, cast(49 as double)+cast((row_number() over(partition by user_id order by ts,event_id)-1)*25+event_id%3 as double)*cast(0.0001 as double) lat, cast(6 as double)+cast(event_id%5 as double)*cast(0.0001 as double) lon, case when event_type='error' then null else cast(20+event_id%17 as double) end speed_mps, case when event_type='signup' then null else cast(200+event_id*13%31 as double) end alt_m from events",
    "v_trip": "select user_id trip_id, case when user_id%10=0 then 'ev_awd' else 'ev_2wd' end vehicle, 1700000000+user_id*3600 start_unix, 60+user_id%35 start_soc_pct, 60+user_id%35-user_id%7 end_soc_pct, case when user_id%11=0 then null else cast(5+user_id%20 as double) end ambient_temp_c, case when user_id%3=0 then cast(1000+user_id as double) end start_discharge_kwh, case when user_id%3=0 then cast(1000+user_id+user_id%6 as double) end end_discharge_kwh, case when user_id%3=0 then cast(900+user_id as double) end start_charge_kwh, case when user_id%3=0 then cast(900+user_id+user_id%4-1 as double) end end_charge_kwh, case when user_id%3=1 then cast(60+user_id%35 as double)+cast(0.4 as double) end start_display_soc_pct, case when user_id%3=1 then cast(60+user_id%35-user_id%7 as double)+cast(0.2 as double) end end_display_soc_pct from (select distinct user_id from events) u",
    "v_payload": "select event_id, user_id session_id, concat('620101','EFFBE7EF',lpad(upper(hex(event_id%201)),2,'0'),'0000000000',lpad(upper(hex(event_id*7919%65536)),4,'0'),lpad(upper(hex(event_id*31%65536)),4,'0')) payload_hex from events",
    "v_line": "select event_id, case event_type when 'error' then 'NO DATA' when 'signup' then 'SEARCHING...' when 'view' then 'OK' when 'purchase' then 'BUS INIT: OK' else concat('7EC 03 62 ',lpad(upper(hex(event_id%256)),2,'0'),' ',lpad(upper(hex(event_id*7%256)),2,'0')) end line from events",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    for t in _TABLES[name]:
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(SQL[name])
