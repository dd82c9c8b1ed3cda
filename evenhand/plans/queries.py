"""One query per operator over the applications, and its SQL for the same tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evenhand.functions import clean as C
from evenhand.operators import drift as D
from evenhand.operators import mitigate as T
from evenhand.operators import model as M
from evenhand.operators import profile as P
from evenhand.operators import recourse as R
from evenhand.operators import sampling as S
from evenhand.operators import screen as A
from evenhand.operators import shrink as E
from evenhand.operators import verify as V
from evenhand.operators.kept import shared_dir, written
from evenhand.plans import audit as U
from evenhand.sources import register as src
from evenhand.streaming import ingest as I

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of the applications; ``sql`` may use app (all rows) and kept (purchases dropped)."""

    def add(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(src.applications(spark, sf_dir))
        if sql is not None:
            SQL[name] = f"with app as ({src.SQL}), kept as (select * from app where action_taken <> '6'){', ' if sql.lstrip().startswith('+') else ' '}{sql.lstrip().lstrip('+')}"
        return f

    return add


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


RATE = "count(*) as applications, cast(sum(case when action_taken='3' then 1 else 0 end) as bigint) as denials"
ROUNDED = "round(cast(denials as double)/applications, 6) as denial_rate, round(1 - cast(denials as double)/applications, 6) as approval_rate"
LONG = "(select lei, 'derived_race' as group_column, derived_race as group_value, action_taken from kept union all select lei, 'derived_ethnicity', derived_ethnicity, action_taken from kept union all select lei, 'derived_sex', derived_sex, action_taken from kept)"
SCREEN = f"""rates as (select lei, group_column, group_value, {RATE} from {LONG} group by all),
 r as (select *, 1 - cast(denials as double)/applications as approval_rate from rates),
 b as (select *, first_value(group_value) over w as bg, first_value(approval_rate) over w as br, max(applications) over (partition by lei, group_column) >= 100 as anyc from r
  window w as (partition by lei, group_column order by applications >= 100 desc, approval_rate desc, group_value asc nulls last)),
 scr as (select lei, group_column, group_value, applications, denials, approval_rate, case when applications < 100 or not anyc then 'SUPPRESSED' when br = 0 then 'UNDEFINED' else 'OK' end as status,
  case when anyc then bg else 'NONE_ELIGIBLE' end as reference_group, case when applications >= 100 and anyc and br <> 0 then approval_rate/br end as ratio from b)"""
NUM = lambda c: f"case when trim({c}) not in ('NA','Exempt','','NA ','Not applicable') then try_cast(trim({c}) as double) end"
INC = f"({NUM('income')})*1000.0"
RANK = "case debt_to_income_ratio when '<20%' then 0.0 when '20%-<30%' then 1.0 when '30%-<36%' then 2.0 when '50%-60%' then 17.0 when '>60%' then 18.0 else case when try_cast(debt_to_income_ratio as double) is not null then least(greatest(try_cast(debt_to_income_ratio as double), 36.0), 49.0) - 33.0 end end"

# A closed-form score of a row and an added income, so that SQL can follow it.
Z = "2.0 - {income}/100000.0 + {loan}/{income}/2.0 + {rank}/20.0"


def demo_scores(df: DataFrame) -> DataFrame:
    """Decisions with a closed-form denial score, as R7 to R19 need one."""
    # Missing ratios go by their text: a filter on the rank would be pushed into the scan with the register's own cases in each branch.
    rows = A.keep(df, "decisions_only").where(~F.trim("debt_to_income_ratio").isin(C.MISSING_TEXT))
    rows = rows.select("app_id", "lei", F.col("derived_race").alias("g"), C.denied().alias("y"), C.to_float("loan_amount").alias("principal"), (C.to_float("income") * 1000.0).alias("inc"), C.debt_to_income_rank().alias("rank"))
    rows = rows.where("inc > 0")
    return rows.withColumn("score", demo_score(F.lit(0.0)))


def demo_score(added):
    income = F.col("inc") + added
    return F.round(1.0 / (1.0 + F.exp(-(2.0 - income / 100000.0 + F.col("principal") / income / 2.0 + F.col("rank") / 20.0))), 9)


DEMO = f"""+ d0 as (select app_id, lei, derived_race as g, cast(action_taken='3' as int) as y, {NUM('loan_amount')} as principal, {INC} as inc, {RANK} as rank from app where action_taken in ('1','2','3')),
 demo as (select *, round(1.0/(1.0+exp(-(2.0 - inc/100000.0 + principal/inc/2.0 + rank/20.0))), 9) as score from d0 where inc > 0 and rank is not null)"""
ELIGIBLE = "g not in ('Race Not Available','Joint','Free Form Text Only','NA','')"


# Sources and filters -------------------------------------------------------
@query("s2_union_by_name", " select activity_year, count(*) as n from app group by 1")
def _(df):
    cols = df.columns
    early, late = df.where("activity_year < '1998'"), df.where("activity_year >= '1998'").select(*reversed(cols))
    return early.unionByName(late).groupBy("activity_year").agg(F.count("*").alias("n"))


@query("s3_registered_frame", " select lei, count(*) as n from app group by 1")
def _(df):
    src.register(df)
    return df.sparkSession.sql("select lei, count(*) as n from frame group by lei")


@query("s8_wanted_files", " select distinct state_code, activity_year from app where activity_year >= '1997' or state_code < 'S05'")
def _(df):
    keys = df.select("state_code", "activity_year").distinct()
    done = keys.where("activity_year < '1997'")
    return src.wanted_files(keys, done, done.where("state_code >= 'S05'"), ["state_code", "activity_year"])


INGESTED = ["app_id", "lei", "state_code", "activity_year", "action_taken"]


@query("st1_streamed_ingest", " select activity_year, count(*) as n, count(distinct app_id) as applications, 0::bigint as third_run, 1::bigint as set_aside from app group by 1")
def _(df):
    """A folder that grows: half of the years, then the other half and a broken file, then nothing new."""
    spark, rows = df.sparkSession, written(df.select(*INGESTED))
    root = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"

    def arrive(part: DataFrame, name: str) -> None:
        part.write.options(header=True, escape='"').csv(f"{root}/in/{name}")

    def run() -> int:
        return I.ingest_register(spark, f"{root}/in", f"{root}/table", f"{root}/aside", f"{root}/checkpoint", INGESTED)

    arrive(rows.where("activity_year < '1996'").repartition(4, "state_code"), "first")
    run()
    arrive(rows.where("activity_year >= '1996'").repartition(4, "state_code"), "second")
    arrive(rows.select("lei").distinct().coalesce(1), "broken")
    run()
    third, aside = run(), spark.read.json(f"{root}/aside").count()
    table = spark.read.parquet(f"{root}/table").groupBy("activity_year").agg(F.count("*").alias("n"), F.countDistinct("app_id").alias("applications"))
    return table.withColumns({"third_run": F.lit(third).cast("bigint"), "set_aside": F.lit(aside).cast("bigint")})


@query("s10_misplaced_by_file", " select place, count(*) as rows, count(*) filter (where activity_year <> right(place, 4)) as misplaced from (select activity_year, state_code || '_' || case when state_code < 'S10' then '1995' else activity_year end as place from app) group by 1")
def _(df):
    # Folders by state and year, as files arrive; some states put all their years into one.
    year = F.when(F.col("state_code") < "S10", "1995").otherwise(F.col("activity_year"))
    root = f"{shared_dir(df.sparkSession)}/places-{uuid.uuid4().hex}"
    rows = df.select("state_code", "activity_year", F.concat_ws("_", "state_code", year).alias("place"))
    rows.repartition("place").write.partitionBy("place").parquet(root)
    return src.misplaced_by_file(df.sparkSession.read.parquet(root))


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
QUERIES["s7_headers"] = lambda spark, sf_dir: src.headers(spark, sf_dir)
SQL["s7_headers"] = f"select table_name || '.parquet' as file, cast(ordinal_position as int) as place, column_name as \"column\" from information_schema.columns where table_name in {TABLES}"
#: SQL has no way to name the folder; a test holds it against DuckDB's digests of the same files.
QUERIES["s9_manifest"] = lambda spark, sf_dir: src.manifest(spark, sf_dir)


@query("s11_one_lender", " select app_id, action_taken from app where lei='L000003'")
def _(df):
    return df.where(F.col("lei") == "L000003").select("app_id", "action_taken")


@query("f1_drop_purchased", " select action_taken, count(*) as n from kept group by 1")
def _(df):
    return A.keep(df, "not_purchased").groupBy("action_taken").agg(F.count("*").alias("n"))


@query("f2_decisions_only", " select action_taken, count(*) as n from app where action_taken in ('1','2','3') group by 1")
def _(df):
    return A.keep(df, "decisions_only").groupBy("action_taken").agg(F.count("*").alias("n"))


@query("f3_lender_scope", f" select derived_race as group_value, {RATE} from kept where lei='L000005' group by 1")
def _(df):
    return A.group_rates(df, "derived_race", lei="L000005").select("group_value", "applications", "denials")


@query("f4_lender_known", " select count(*) as n from app where lei is not null")
def _(df):
    return A.keep(df, "lender_known").agg(F.count("*").alias("n"))


@query("f7_allowed_projection", f" select app_id, loan_type, loan_purpose, {NUM('loan_amount')} as loan_amount from app")
def _(df):
    M.check_allowed(["loan_type", "loan_purpose", "loan_amount"])  # raises for any other kind of column
    return df.select("app_id", "loan_type", "loan_purpose", C.to_float("loan_amount").alias("loan_amount"))


@query("f8_time_split", " select case when cast(activity_year as int) < 2000 then 'train' else 'test' end as side, count(*) as n from app group by 1")
def _(df):
    a, b = M.time_split(df, 2000)
    return a.agg(F.lit("train").alias("side"), F.count("*").alias("n")).union(b.agg(F.lit("test"), F.count("*")))


@query("f9_two_groups", " select app_id, derived_race from app where derived_race in ('BUILDING','FURNITURE')")
def _(df):
    return df.where(F.col("derived_race").isin("BUILDING", "FURNITURE")).select("app_id", "derived_race")


@query("f10_eligible_groups", " select derived_race as group_value, count(*) as n from app group by 1 having count(*) >= 100 and derived_race not in ('Race Not Available','Joint','Free Form Text Only','NA','')")
def _(df):
    return M.eligible_groups(df, "derived_race")


@query("f11_floor", " select lei, derived_race, count(*) as n, count(*) < 100 as below from kept group by 1, 2")
def _(df):
    return A.keep(df, "not_purchased").groupBy("lei", "derived_race").agg(F.count("*").alias("n")).withColumn("below", F.col("n") < F.lit(A.FLOOR))


# Scalar expressions ----------------------------------------------------------
@query("e2_sentinels", " select app_id, case when loan_to_value_ratio not in ('NA','Exempt') then loan_to_value_ratio end as ltv, case when income <> 'NA' then income end as income, case when applicant_age not in ('NA','8888') then applicant_age end as age from app")
def _(df):
    return df.select("app_id", C.replace_sentinels("loan_to_value_ratio").alias("ltv"), C.replace_sentinels("income").alias("income"), C.replace_sentinels("applicant_age").alias("age"))


@query("e3_income_dollars", " select app_id, case when income <> 'NA' then cast(income as double) end * 1000.0 as dollars from app")
def _(df):
    return df.select("app_id", C.income_dollars().alias("dollars"))


@query("e4_debt_to_income_position", f" select app_id, case when debt_to_income_ratio not in ('NA','Exempt') then cast(list_position({C.DTI_LABELS}, debt_to_income_ratio) - 1 as int) end as position from app where debt_to_income_ratio in ('NA','Exempt') or list_contains({C.DTI_LABELS}, debt_to_income_ratio)")
def _(df):
    rows = df.where(F.col("debt_to_income_ratio").isin("NA", "Exempt", *C.DTI_LABELS))
    return C.check_debt_to_income(rows).select("app_id", C.debt_to_income_position().alias("position"))


@query("e5_loan_to_value", " select app_id, case when loan_to_value_ratio not in ('NA','Exempt') then cast(loan_to_value_ratio as double) end as ltv from app")
def _(df):
    return df.select("app_id", C.loan_to_value().alias("ltv"))


@query("e6_to_float", f" select app_id, {NUM('property_value')} as value from app")
def _(df):
    return df.select("app_id", C.to_float("property_value").alias("value"))


@query("e7_debt_to_income_rank", f" select app_id, cast({RANK} as double) as rank from app")
def _(df):
    return df.select("app_id", C.debt_to_income_rank().alias("rank"))


@query("e8_debt_to_income_midpoint", """ select app_id, cast(case when debt_to_income_ratio in ('NA','Exempt') then null when debt_to_income_ratio like '<%' then cast(regexp_extract(debt_to_income_ratio,'([0-9]+)',1) as double)/2
 when debt_to_income_ratio like '>%' then cast(regexp_extract(debt_to_income_ratio,'([0-9]+)',1) as double)+5 when debt_to_income_ratio like '%-%' then (cast(regexp_extract(debt_to_income_ratio,'^([0-9]+)',1) as double)+cast(regexp_extract(debt_to_income_ratio,'([0-9]+)%$',1) as double))/2
 else cast(debt_to_income_ratio as double) end as double) as midpoint from app""")
def _(df):
    return df.select("app_id", C.debt_to_income_midpoint().alias("midpoint"))


@query("e9_category", " select app_id, case when trim(county_code) in ('NA','na','') or county_code is null then 'missing' else trim(county_code) end as county, trim(loan_purpose) as purpose from app")
def _(df):
    return df.select("app_id", C.category("county_code").alias("county"), C.category("loan_purpose").alias("purpose"))


@query("e10_controlled_numbers", " select app_id, try_cast(trim(income) as double)*1000.0 as income, try_cast(trim(loan_to_value_ratio) as double) as ltv from app")
def _(df):
    return df.select("app_id", C.number_or_null("income", 1000.0).alias("income"), C.number_or_null("loan_to_value_ratio").alias("ltv"))


@query("e11_denied", " select app_id, cast(action_taken='3' as int) as y from app")
def _(df):
    return df.select("app_id", C.denied().alias("y"))


@query("e12_loan_to_income", f" select app_id, ({NUM('loan_amount')}) / nullif({INC}, 0) as ratio from app")
def _(df):
    return df.select("app_id", C.loan_to_income().alias("ratio"))


@query("e13_missing_flags", f" select app_id, cast({NUM('income')} is null as int) as income_missing, cast({NUM('property_value')} is null as int) as property_value_missing from app")
def _(df):
    return df.select("app_id", *(C.to_float(c).isNull().cast("int").alias(f"{c}_missing") for c in ("income", "property_value")))


@query("e14_one_hot", " select app_id, cast(loan_type='1' as double) as loan_type_1, cast(loan_type='2' as double) as loan_type_2, cast(loan_type='3' as double) as loan_type_3, cast(loan_type='4' as double) as loan_type_4, cast(loan_purpose='31' as double) as d_loan_purpose_31, cast(loan_purpose='32' as double) as d_loan_purpose_32 from app")
def _(df):
    every = M.one_hot(M.levels(df, ("loan_type",)))
    fewer = M.one_hot(M.levels(df, ("loan_purpose",), C.category), C.category, drop_first=True)
    return df.select("app_id", *(c.alias(n) for n, c in every.items()), *(c.alias(f"d_{n}") for n, c in fewer.items()))


@query("e16_rates", f" select lei as group_value, applications, denials, {ROUNDED} from (select lei, {RATE} from kept group by lei)")
def _(df):
    counts = A.keep(df, "not_purchased").groupBy(F.col("lei").alias("group_value")).agg(F.count("*").alias("applications"), F.sum(C.denied()).alias("denials"))
    return r6(A.with_rates(counts), "denial_rate", "approval_rate")


@query("e17_auc_words", " select lei, round(2*a - 1, 6) as gini, round((a - 0.4)/0.4*100, 6) as better, cast(round_even(a*100, 0) as bigint) as pairs from (select lei, cast(sum(case when action_taken='3' then 1 else 0 end) as double)/count(*) as a from kept group by lei)")
def _(df):
    a = A.keep(df, "not_purchased").groupBy("lei").agg(F.avg(C.denied()).alias("a"))
    return a.select("lei", F.round(C.gini(F.col("a")), 6).alias("gini"), F.round((F.col("a") - 0.4) / 0.4 * 100, 6).alias("better"), C.pairs_per_100(F.col("a")).cast("bigint").alias("pairs"))


#: The density's integral again, with other nodes.
AREA = " + ".join(f"{w!r}*exp(z*z*{-t * t / 2!r})" for t, w in zip((np.polynomial.legendre.leggauss(44)[0] + 1) / 2, np.polynomial.legendre.leggauss(44)[1] / 2)).replace("np.float64(", "(")


@query("e18_normal_tail", f"+ n as (select app_id, round(({NUM('loan_amount')} - 40000.0) / 20000.0, 6) as z from app) select app_id, z, round(0.5 - z*0.3989422804014327*({AREA}), 6) as tail from n")
def _(df):
    z = F.round((C.to_float("loan_amount") - 40000.0) / 20000.0, 6)
    return df.select("app_id", z.alias("z")).select("app_id", "z", F.round(C.normal_tail(F.col("z")), 6).alias("tail"))


@query("e19_expected_value", f" select lei, round(4000.0 - 0.02*0.4*avg({NUM('loan_amount')}), 4) as value from kept group by lei")
def _(df):
    rows = A.keep(df, "not_purchased").groupBy("lei").agg(F.avg(C.to_float("loan_amount")).alias("p"))
    return rows.select("lei", F.round(C.expected_value(F.col("p")), 4).alias("value"))


@query("e21_psi_term", " select lei, round((greatest(a,1e-4)-greatest(b,1e-4))*ln(greatest(a,1e-4)/greatest(b,1e-4)), 6) as term from (select lei, avg(cast(action_taken='3' as double)) as a, avg(cast(action_taken='1' as double)) as b from app group by lei)")
def _(df):
    rows = df.groupBy("lei").agg(F.avg((F.col("action_taken") == "3").cast("double")).alias("a"), F.avg((F.col("action_taken") == "1").cast("double")).alias("b"))
    return rows.select("lei", F.round(C.psi_term(F.col("a"), F.col("b")), 6).alias("term"))


@query("e23_code_labels", " select case loan_purpose when '1' then 'purchase' when '31' then 'refinancing' when '32' then 'cash-out' end as label, count(*) as n from app group by 1")
def _(df):
    names = F.create_map(*(F.lit(x) for x in ("1", "purchase", "31", "refinancing", "32", "cash-out")))
    return df.groupBy(names[F.col("loan_purpose")].alias("label")).agg(F.count("*").alias("n"))


# Joins -------------------------------------------------------------------------
FIXED = f"+ r as (select derived_race as group_value, {RATE} from kept group by 1), x as (select *, 1 - cast(denials as double)/applications as a from r) select group_value, applications, round(a, 4) as approval_rate, round(a/(select a from x where group_value='FURNITURE'), 4) as ratio from x"


@query("j1_scalar_reference", FIXED)
def _(df):
    return A.fixed_reference(df, "derived_race", "FURNITURE")


@query("j2_lender_reference", f"+ {SCREEN} select lei, group_value, reference_group from scr where group_column='derived_race'")
def _(df):
    rates = A.group_rates(A.keep(df, "lender_known"), "derived_race", ("lei",))
    return A.screened(rates, ("lei",)).select("lei", "group_value", "reference_group")


@query("j3_both_groups", f"+ c as (select lei, derived_race as g, {RATE} from kept group by 1, 2) select a.lei, a.applications as n_g, a.denials as d_g, b.applications as n_r, b.denials as d_r from c a join c b on a.lei=b.lei and a.g='BUILDING' and b.g='FURNITURE' where a.applications >= 5 and b.applications >= 5")
def _(df):
    return E.both_groups(A.group_rates(df, "derived_race", ("lei",)), "BUILDING", "FURNITURE")


def _two_counts(df):
    count = lambda d: d.groupBy("lei", "derived_race").agg(F.count("*").alias("n"), F.avg(C.denied()).alias("rate"))
    a, b = A.keep(df, "not_purchased"), A.keep(df, "decisions_only")
    return count(a.where("lei <> 'L000001'")), count(b.where("lei <> 'L000002'"))


PAIR = """+ a as (select lei, derived_race, count(*) as n, avg(cast(action_taken='3' as double)) as rate from kept where lei <> 'L000001' group by 1,2), b as (select lei, derived_race, count(*) as n, avg(cast(action_taken='3' as double)) as rate from app where action_taken in ('1','2','3') and lei <> 'L000002' group by 1,2),
 m as (select coalesce(a.lei,b.lei) as lei, a.n as an, b.n as bn, a.rate as ar, b.rate as br from a full join b on a.lei=b.lei and a.derived_race=b.derived_race)"""


@query("j4_table_parity", PAIR + " select count(*) filter (where bn is null) as only_left, count(*) filter (where an is null) as only_right, count(*) filter (where an is not null and bn is not null and an<>bn) as mismatched, count(*) filter (where an=bn) as matched from m")
def _(df):
    return V.table_parity(*_two_counts(df), ["lei", "derived_race"], ["n"])


@query("j5_tolerant_parity", PAIR + " select count(*) filter (where bn is null) as only_left, count(*) filter (where an is null) as only_right, count(*) filter (where an is not null and bn is not null and abs(ar-br)>0.05) as mismatched, count(*) filter (where abs(ar-br)<=0.05) as matched from m")
def _(df):
    return V.table_parity(*_two_counts(df), ["lei", "derived_race"], ["rate"], 0.05)


@query("j6_category_alignment", " select derived_race as bin, count(*) filter (where activity_year='1996') as a, count(*) filter (where activity_year='1997' and derived_race <> 'BUILDING') as b from app group by 1")
def _(df):
    a, b = (df.where(w).groupBy(F.col("derived_race").alias("bin")).agg(F.count("*").alias(n)) for w, n in (("activity_year='1996'", "a"), ("activity_year='1997' and derived_race <> 'BUILDING'", "b")))
    return a.join(b, "bin", "full_outer").select("bin", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))


@query("j7_group_cutoffs", DEMO + f", c as (select g, quantile_cont(score, 0.7) as cut from demo group by g having count(*) >= 100 and {ELIGIBLE}) select app_id, cast(score < coalesce(cut, 0.8) as int) as approve from demo left join c using (g)")
def _(df):
    rows = demo_scores(df)
    return T.decide(rows, 0.8, T.group_cutoffs(rows, 0.3)).select("app_id", "approve")


WEIGHTS = DEMO + ", n as (select g, y, count(*) as n from demo group by 1,2), w as (select g, y, sum(n) over (partition by g)*1.0*sum(n) over (partition by y)/sum(n) over ()/n as weight from n)"


@query("j8_cell_weights", WEIGHTS + " select app_id, round(cast(weight as double), 6) as weight from demo join w using (g, y)")
def _(df):
    rows = demo_scores(df)
    return rows.join(F.broadcast(T.reweighing(rows)), ["g", "y"]).select("app_id", F.round("weight", 6).alias("weight"))


GRID = ", ".join(f"({x!r}::double)" for x in [0.0, *map(float, R.FINE), *R.coarse_grid()])


@query("j10_recourse_grid", DEMO + f", grid(x) as (values {GRID}) select app_id, count(*) as steps, count(*) filter (where round(1.0/(1.0+exp(-(2.0 - (inc+x)/100000.0 + principal/(inc+x)/2.0 + rank/20.0))), 9) < 0.5) as below from demo, grid group by app_id")
def _(df):
    grid = F.array(*(F.lit(float(x)) for x in [0, *R.FINE, *R.coarse_grid()]))
    below = F.size(F.filter(grid, lambda x: demo_score(x) < 0.5))
    return demo_scores(df).select("app_id", F.size(grid).cast("bigint").alias("steps"), below.cast("bigint").alias("below"))


@query("j11_list_overlap", f"+ {SCREEN}, f as (select distinct lei from scr where ratio < 0.8), h as (select lei from kept group by lei having avg(cast(action_taken='3' as double)) > 0.3) select coalesce(f.lei, h.lei) as lei, f.lei is not null as flagged, h.lei is not null as high from f full join h on f.lei=h.lei")
def _(df):
    f = A.flagged_lenders(A.lender_screen(df)).select("lei", F.lit(True).alias("flagged"))
    h = A.keep(df, "not_purchased").groupBy("lei").agg(F.avg(C.denied()).alias("r")).where("r > 0.3").select("lei", F.lit(True).alias("high"))
    return f.join(h, "lei", "full_outer").select("lei", F.coalesce("flagged", F.lit(False)).alias("flagged"), F.coalesce("high", F.lit(False)).alias("high"))


@query("j12_right_closed_bins", f" select app_id, cast(case when v <= 20000 then 0 when v <= 40000 then 1 when v <= 60000 then 2 else 3 end as int) as bin from (select app_id, {NUM('loan_amount')} as v from app)")
def _(df):
    edges = F.array(*(F.lit(float(x)) for x in (20000, 40000, 60000)))
    return df.select("app_id", D.bin_of(C.to_float("loan_amount"), edges).alias("bin"))


# Aggregations --------------------------------------------------------------------
def _rate_sql(group: str, where: str = "action_taken <> '6'") -> str:
    return f" select group_value, applications, denials, {ROUNDED} from (select {group} as group_value, {RATE} from app where {where} group by 1)"


@query("g1_denial_rate", _rate_sql("derived_race"))
def _(df):
    return r6(A.group_rates(df, "derived_race"), "denial_rate", "approval_rate")


@query("g2_approval_rate", _rate_sql("derived_sex"))
def _(df):
    return r6(A.group_rates(df, "derived_sex"), "denial_rate", "approval_rate")


@query("g3_decisions_rate", _rate_sql("derived_race", "action_taken in ('1','2','3')"))
def _(df):
    return r6(A.group_rates(df, "derived_race", decisions=True), "denial_rate", "approval_rate")


@query("g4_lender_group_rate", f" select lei, group_value, applications, denials, {ROUNDED} from (select lei, derived_race as group_value, {RATE} from kept group by 1, 2)")
def _(df):
    return r6(A.group_rates(df, "derived_race", ("lei",)), "denial_rate", "approval_rate")


@query("g5_all_columns_rate", f" select lei, group_column, group_value, applications, denials, {ROUNDED} from (select lei, group_column, group_value, {RATE} from {LONG} group by all)")
def _(df):
    return r6(A.all_group_rates(df), "denial_rate", "approval_rate")


@query("g6_rows_by_year", " select activity_year, count(*) as n, count(distinct lei) as lenders from app group by 1")
def _(df):
    return df.groupBy("activity_year").agg(F.count("*").alias("n"), F.countDistinct("lei").alias("lenders"))


@query("g6_sketches", " select activity_year, count(distinct app_id) as exact, true as within_2_pct from app group by 1")
def _(df):
    stored = written(P.sketches(df, "app_id", ["activity_year", "state_code"]))
    exact = df.groupBy("activity_year").agg(F.countDistinct("app_id").alias("exact"))
    both = exact.join(P.distinct_from_sketches(stored, ["activity_year"]), "activity_year")
    return both.select("activity_year", "exact", (F.abs(F.col("estimate") - F.col("exact")) <= 0.02 * F.col("exact")).alias("within_2_pct"))


@query("g7_share_of_value", " select round(count(*) filter (where derived_race='Race Not Available')::double/count(*), 6) as share from app")
def _(df):
    return r6(P.share_of(df, "derived_race", "Race Not Available"), "share")


TOTALS = " ".join(f"{'union all' if i else ''} select '{k}' as key, count(*) as parts, cast(sum(n) as bigint) as sum, (select count(*) from app) as total, sum(n) = (select count(*) from app) as agrees from (select {k}, count(*) as n from app group by 1)" for i, k in enumerate(("state_code", "activity_year", "derived_sex", "loan_type")))


@query("g8_totals_agree", TOTALS)
def _(df):
    return V.totals_agree(df, ["state_code", "activity_year", "derived_sex", "loan_type"])


SENT = ("income", "loan_to_value_ratio", "debt_to_income_ratio", "property_value", "applicant_age")


@query("g9_sentinel_counts", " union all ".join([f"select '{c}' as \"column\", '{s}' as sentinel, count(*) filter (where {c}='{s}') as rows from app" for c in SENT for s in C.sentinels(c)] + [f"select '{c}', 'TOTAL', count(*) from app" for c in SENT]))
def _(df):
    return P.sentinel_counts(df, list(SENT))


DICT = ("action_taken", "lei", "derived_race", "income", "debt_to_income_ratio", "property_value")


@query("g10_dictionary", " union all ".join(f"select '{c}' as \"column\", 'string' as type, count(distinct {c}) as distinct_values, count(*) filter (where {c} is null) as null_rows, count(*) filter (where {c} in ({', '.join(repr(s) for s in C.sentinels(c))})) as sentinel_rows from app" for c in DICT))
def _(df):
    return P.dictionary(df, list(DICT))


@query("g11_exact_quantiles", f" select derived_race, round(quantile_cont(v, 0.9), 6) as p90, round(median(v), 6) as med from (select derived_race, {NUM('loan_amount')} as v from app) group by 1")
def _(df):
    return r6(S.order_statistics(df, C.to_float("loan_amount"), {"p90": 0.9, "med": 0.5}, ("derived_race",)).drop("n"), "p90", "med")


@query("g12_principal", f" select lei, round(avg(v), 4) as mean_principal, round(median(v), 4) as median_principal from (select lei, {NUM('loan_amount')} as v from app where action_taken='1') group by 1")
def _(df):
    rows = df.where("action_taken = '1'").select("lei", C.to_float("loan_amount").alias("v"))
    mean = rows.groupBy("lei").agg(F.round(F.avg("v"), 4).alias("mean_principal"))
    return mean.join(S.order_statistics(rows, F.col("v"), {"m": 0.5}, ("lei",)), "lei").select("lei", "mean_principal", F.round("m", 4).alias("median_principal"))


RUNS = "+ runs as (select derived_race as technique, activity_year as seed, avg(cast(action_taken='3' as double)) as v from app group by 1, 2)"


def _runs(df):
    return df.groupBy(F.col("derived_race").alias("technique"), F.col("activity_year").alias("seed")).agg(F.avg(C.denied()).alias("v"))


@query("g13_seed_summary", RUNS + " select technique, round(avg(v),4) as mean, round(stddev_samp(v),4) as sd, round(min(v),4) as low, round(max(v),4) as high from runs group by 1")
def _(df):
    return P.summary_over_seeds(_runs(df), "technique", "v")


@query("g14_seed_ranges", RUNS + " select technique, round(min(v),6) as low, round(max(v),6) as high from runs where seed <> '1995' group by 1")
def _(df):
    runs = _runs(df).withColumn("v", F.when(F.col("seed") != "1995", F.col("v")))
    return runs.groupBy("technique").agg(F.round(F.min("v"), 6).alias("low"), F.round(F.max("v"), 6).alias("high"))


MISS = ("income", "property_value", "loan_to_value_ratio")


@query("g15_missing_gap", " union all ".join(f"select '{c}' as \"column\", round(avg(m) filter (where action_taken='3'),6) as missing_denied, round(avg(m) filter (where action_taken<>'3'),6) as missing_other, round(avg(m) filter (where action_taken='3') - avg(m) filter (where action_taken<>'3'),6) as gap from (select action_taken, cast({NUM(c)} is null as double) as m from app)" for c in MISS))
def _(df):
    return r6(P.missing_gap(df, list(MISS)), "missing_denied", "missing_other", "gap")


@query("g16_cell_shares", WEIGHTS + " select g, y, round(cast(weight as double), 6) as weight from w")
def _(df):
    return r6(T.reweighing(demo_scores(df)), "weight")


@query("g17_outcomes", " select action_taken, count(*) as n from app group by 1")
def _(df):
    return df.groupBy("action_taken").agg(F.count("*").alias("n"))


@query("g18_suspicious_codes", "+ h as (select cast(l as bigint) as value, count(*) as n from (select try_cast(debt_to_income_ratio as bigint) as l from app) where l is not null group by 1), x as (select *, lag(n) over (order by value) as b, lead(n) over (order by value) as a from h) select value, n, round(n/((coalesce(b,a)+coalesce(a,b))/2.0), 6) as ratio from x")
def _(df):
    return r6(P.suspicious_code(df, "debt_to_income_ratio"), "ratio")


# Windows, sorts, sets ---------------------------------------------------------------
@query("w1_best_group", f"+ {SCREEN} select distinct lei, group_column, reference_group from scr")
def _(df):
    return A.lender_screen(df).select("lei", "group_column", "reference_group").distinct()


QUOTA = "+ c as (select derived_race as stratum, count(*) as rows from app group by 1), t as (select *, sum(rows) over () as total from c), e as (select stratum, rows, floor(rows*997/total) as base, (rows*997) % total as rest from t), k as (select *, 997 - sum(base) over () as lft, row_number() over (order by rest desc, stratum asc nulls first) as rk from e), q as (select stratum, rows, cast(base + case when rk <= lft then 1 else 0 end as bigint) as quota from k)"


@query("w2_quotas", QUOTA.replace("floor(rows*997/total)", "(rows*997)//total") + " select * from q")
def _(df):
    return S.quotas(df.groupBy(F.col("derived_race").alias("stratum")).agg(F.count("*").alias("rows")), 997)


@query("w3_stratified_draw", QUOTA.replace("floor(rows*997/total)", "(rows*997)//total") + ", o as (select app_id, derived_race, row_number() over (partition by derived_race order by md5(concat('7:', app_id)), app_id) as r from app) select app_id, derived_race from o join q on derived_race = stratum where r <= quota")
def _(df):
    return S.stratified_draw(df.select("app_id", "derived_race"), "derived_race", "app_id", 997, seed=7)


AUC = "each as (select s, sum(y) as pos, sum(1-y) as neg from {rows} group by s), cum as (select *, coalesce(sum(neg) over (order by s rows between unbounded preceding and 1 preceding), 0) as below from each)"


@query("w4_exact_auc", DEMO + ", z as (select score as s, y from demo), " + AUC.format(rows="z") + " select round(sum(pos*(below+neg/2.0))/(sum(pos)*1.0*sum(neg)), 6) as auc, cast(sum(pos) as bigint) as positives, cast(sum(neg) as bigint) as negatives from cum")
def _(df):
    return r6(S.exact_auc(demo_scores(df), "score", "y"), "auc")


@query("w5_year_pairs", "+ y as (select distinct cast(activity_year as int) as year_a from app), p as (select year_a, lead(year_a) over (order by year_a) as year_b from y) select * from p where year_b is not null")
def _(df):
    return D.adjacent_years(df)


WATER = "+ s(step, filter, n) as (values {v}) select cast(step as int) as step, filter, coalesce(lag(n) over (order by step), n) as rows_before, n as rows_after from s"
STEPS = [("raw", "true"), ("not_purchased", "action_taken <> '6'"), ("income_known", "action_taken <> '6' and income <> 'NA'"), ("decisions_only", "action_taken in ('1','2','3') and income <> 'NA'")]
WATER = "+ s as (" + " union all ".join(f"select {i} as step, '{n}' as filter, count(*) as n from app where {w}" for i, (n, w) in enumerate(STEPS)) + ") select cast(step as int) as step, filter, coalesce(lag(n) over (order by step), n) as rows_before, n as rows_after from s"


@query("w6_running_counts", WATER)
def _(df):
    return A.waterfall(df, ["not_purchased", "income_known", "decisions_only"])


@query("w7_widest_pair", "+ r as (select lei, derived_race as g, avg(cast(action_taken='3' as double)) as d from kept group by 1,2) select lei, arg_max(g, (d, g)) as high, arg_min(g, (d, g)) as low, round(max(d)-min(d), 6) as gap from r group by lei")
def _(df):
    r = A.group_rates(df, "derived_race", ("lei",))
    order = F.struct("denial_rate", "group_value")
    return r.groupBy("lei").agg(F.max_by("group_value", order).alias("high"), F.min_by("group_value", order).alias("low"), F.round(F.max("denial_rate") - F.min("denial_rate"), 6).alias("gap"))


@query("k1_nulls_last", " select row_number() over (order by g asc nulls last) as place, g, n from (select nullif(derived_race, 'Race Not Available') as g, count(*) as n from kept group by 1)")
def _(df):
    rows = A.keep(df, "not_purchased").groupBy(F.nullif("derived_race", F.lit("Race Not Available")).alias("g")).agg(F.count("*").alias("n"))
    return rows.select(F.row_number().over(Window.orderBy(F.col("g").asc_nulls_last())).cast("bigint").alias("place"), "g", "n").orderBy("place")


@query("k2_by_size", " select derived_race as g, count(*) as n from kept group by 1 order by n desc, g")
def _(df):
    return A.keep(df, "not_purchased").groupBy(F.col("derived_race").alias("g")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "g")


GAPS = f"""+ c as (select lei, derived_race as g, {RATE} from kept group by 1, 2),
 b as (select a.lei, a.applications as n_g, a.denials as d_g, b.applications as n_r, b.denials as d_r from c a join c b on a.lei=b.lei and a.g='BUILDING' and b.g='FURNITURE' where a.applications >= 5 and b.applications >= 5),
 p as (select cast(sum(d_g) as double)/sum(n_g) as pg, cast(sum(d_r) as double)/sum(n_r) as pr, count(*) as k from b),
 v as (select b.*, 100.0*(cast(d_g as double)/n_g - cast(d_r as double)/n_r) as gap, 1e4*(pg*(1-pg)/n_g + pr*(1-pr)/n_r) as v, k from b, p),
 s as (select sum(1/v) as sw, sum(gap/v) as swg, sum(gap*gap/v) as swgg, sum(1/(v*v)) as sww, any_value(k) as k from v),
 t as (select greatest(0.0, (swgg - swg*swg/sw - (k-1))/(sw - sww/sw)) as tau2 from s),
 m as (select sum(gap/(v+tau2))/sum(1/(v+tau2)) as mu, any_value(tau2) as tau2 from v, t),
 e as (select lei, n_g, n_r, gap, v, mu, tau2, tau2/(tau2+v) as weight, tau2/(tau2+v)*gap + (1-tau2/(tau2+v))*mu as post, sqrt(tau2/(tau2+v)*v) as sd from v, m)"""


@query("k3_by_probability", GAPS + " select lei, row_number() over (order by round((post-mu)/sd, 6) desc, lei) as place from e")
def _(df):
    rows = _gaps(df).withColumn("z", F.round((F.col("shrunk_gap_pp") - F.col("mu_pp")) / F.col("posterior_sd_pp"), 6))
    return S.places(rows, "z", "lei").select("lei", "place")


@query("k4_top_lenders", GAPS + " select lei, round(post, 6) as shrunk_gap_pp from e order by round(post, 6) desc, lei limit 25")
def _(df):
    return r6(_gaps(df), "shrunk_gap_pp").select("lei", "shrunk_gap_pp").orderBy(F.col("shrunk_gap_pp").desc(), "lei").limit(25)


@query("k5_top_per_group", "+ r as (select derived_race as g, lei, count(*) as n from kept group by 1,2), k as (select *, row_number() over (partition by g order by n desc, lei) as place from r) select g, lei, n, place from k where place <= 3")
def _(df):
    rows = A.keep(df, "not_purchased").groupBy(F.col("derived_race").alias("g"), "lei").agg(F.count("*").alias("n"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("g").orderBy(F.col("n").desc(), "lei")).cast("bigint")).where("place <= 3")


@query("u1_flagged_union", f"+ {SCREEN} select distinct lei from scr where ratio < 0.8")
def _(df):
    return A.flagged_lenders(A.lender_screen(df)).select("lei")


SETS = f"+ {SCREEN}, fa as (select distinct lei from scr where ratio < 0.8 and group_column='derived_race'), fb as (select distinct lei from scr where ratio < 0.8 and group_column='derived_sex'), m as (select fa.lei as x, fb.lei as y from fa full join fb on fa.lei=fb.lei) select count(x) as left_size, count(y) as right_size, count(*) filter (where x is not null and y is not null) as both, count(*) filter (where x is null or y is null) as differ, count(*) filter (where (x is null or y is null) and u.lei is not null) as explained, count(*) filter (where (x is null or y is null) and u.lei is null) as unexplained from m left join (select distinct lei from scr where status='UNDEFINED' and group_column in ('derived_race','derived_sex')) u on u.lei = coalesce(x, y)"


@query("u2_set_comparison", SETS)
def _(df):
    rows = A.lender_screen(df).where("group_column in ('derived_race', 'derived_sex')")
    flagged = rows.where("flagged")
    return V.set_parity(flagged.where("group_column = 'derived_race'"), flagged.where("group_column = 'derived_sex'"), "lei", rows.where("status = 'UNDEFINED'"))


@query("u3_pooled_edges", f" select round(quantile_cont(v, 0.1), 6) as p10, round(quantile_cont(v, 0.5), 6) as p50, round(quantile_cont(v, 0.9), 6) as p90 from (select {NUM('loan_amount')} as v from app where activity_year in ('1996','1997'))")
def _(df):
    rows = df.where(F.col("activity_year").isin("1996", "1997"))
    return r6(S.order_statistics(rows, C.to_float("loan_amount"), {"p10": 0.1, "p50": 0.5, "p90": 0.9}).drop("n"), "p10", "p50", "p90")


# Audit --------------------------------------------------------------------------------
SCR_OUT = "group_value, applications, denials, round(approval_rate, 6) as approval_rate, status, reference_group, round(ratio, 6) as ratio, coalesce(ratio < 0.8, false) as flagged"


def _screen_out(df, *by):
    return r6(df, "approval_rate", "ratio").select(*by, "group_value", "applications", "denials", "approval_rate", "status", "reference_group", "ratio", "flagged")


def _one_screen(where: str) -> str:
    return f"+ r0 as (select derived_race as group_value, {RATE} from app where {where} group by 1), r as (select *, 1 - cast(denials as double)/applications as approval_rate from r0), b as (select *, first_value(group_value) over w as bg, first_value(approval_rate) over w as br, max(applications) over () >= 100 as anyc from r window w as (order by applications >= 100 desc, approval_rate desc, group_value asc nulls last)), scr as (select *, case when applications < 100 or not anyc then 'SUPPRESSED' when br=0 then 'UNDEFINED' else 'OK' end as status, case when anyc then bg else 'NONE_ELIGIBLE' end as reference_group, case when applications >= 100 and br <> 0 then approval_rate/br end as ratio from b) select {SCR_OUT} from scr"


@query("a1_adverse_impact", _one_screen("action_taken <> '6'"))
def _(df):
    return _screen_out(A.adverse_impact(df, "derived_race"))


@query("a2_lender_screen", f"+ {SCREEN} select lei, group_column, {SCR_OUT} from scr")
def lender_screen(df):
    return _screen_out(A.lender_screen(df), "lei", "group_column")


SQL["s12_bucketed_screen"] = SQL["a2_lender_screen"]


@query("s12_bucketed_screen")
def _(df):
    name = f"register_{uuid.uuid4().hex}"
    table = src.bucketed(df.select("lei", "action_taken", *A.PROTECTED), name)
    out = written(_screen_out(A.lender_screen(table), "lei", "group_column"))
    df.sparkSession.sql(f"drop table {name}")
    return out


@query("a3_flagged_lenders", f"+ {SCREEN} select lei, count(*) as flags from scr where ratio < 0.8 group by lei")
def _(df):
    return A.flagged_lenders(A.lender_screen(df))


@query("a4_decisions_only", _one_screen("action_taken in ('1','2','3')"))
def _(df):
    return _screen_out(A.adverse_impact(df, "derived_race", decisions=True))


@query("a4_decisions_summary", f"+ d as (select * from app where action_taken in ('1','2','3')), l as ({LONG[1:-1].replace('kept', 'd')}), r0 as (select group_column, group_value, {RATE} from l group by all), r as (select *, 1-cast(denials as double)/applications as a from r0), b as (select *, max(case when applications>=100 then a end) over (partition by group_column) as br from r) select group_column, cast(sum(applications) as bigint) as applications, cast(sum(denials) as bigint) as denials, count(*) filter (where applications>=100 and a/br<0.8) as below, count(*) filter (where applications>=100 and a/br<0.8 and group_value<>'Free Form Text Only') as below_named from b group by 1")
def _(df):
    return A.decisions_only_summary(df)


@query("a5_fixed_reference", FIXED)
def _(df):
    return A.fixed_reference(df, "derived_race", "FURNITURE")


def _gaps(df):
    return E.shrunken_gaps(A.group_rates(A.keep(df, "lender_known"), "derived_race", ("lei",)), "BUILDING", "FURNITURE")


@query("a6_shrunken_gaps", GAPS + " select lei, n_g as n_group, n_r as n_reference, round(gap, 6) as raw_gap_pp, round(sqrt(v), 6) as se_pp, round(post, 6) as shrunk_gap_pp, round(sd, 6) as posterior_sd_pp, round(weight, 6) as weight, coalesce((post-mu)/nullif(sd, 0) >= 1.6448536269514722, false) as on_watch_list from e")
def _(df):
    return r6(_gaps(df), "raw_gap_pp", "se_pp", "shrunk_gap_pp", "posterior_sd_pp", "weight").drop("p_above_typical", "mu_pp", "tau_pp")


@query("a7_watch_summary", GAPS + f", {SCREEN.replace('b as', 'bb as').replace('from b)', 'from bb)')}, w as (select lei from e where (post-mu)/nullif(sd, 0) >= 1.6448536269514722), f as (select distinct lei from scr where group_column='derived_race' and group_value='BUILDING' and ratio < 0.8) select (select count(*) from e) as scored, (select round(any_value(mu),6) from e) as mu_pp, (select round(sqrt(any_value(tau2)),6) from e) as tau_pp, (select count(*) from w) as watch, (select count(*) from f) as flagged_floor, (select count(*) from w where lei in (select lei from f)) as both_floor, (select count(*) from w where lei not in (select lei from f)) as watch_only, (select count(*) from f where lei not in (select lei from w)) as flagged_only")
def _(df):
    one = A.group_rates(A.keep(df, "lender_known"), "derived_race", ("lei",))
    own = lambda floor: A.screened(one, ("lei",), floor).where("flagged and group_value = 'BUILDING'")
    return r6(E.watch_summary(_gaps(df), own(100), own(1)), "mu_pp", "tau_pp").drop("flagged_any", "both_any")


@query("a8_controlled_disparity")
def _(df):
    return M.controlled_disparity(df)


@query("a8_raw_gap", "+ r as (select derived_race as group_value, count(*) as applications, avg(cast(action_taken='3' as double)) as d from kept group by 1), f as (select arg_min(group_value, (d, group_value)) as ref, min(d) as rd from r where applications >= 100) select group_value, applications, case when applications >= 100 and group_value <> ref then round(100*(d-rd), 6) end as raw_gap_pp, ref as reference_group, round((select avg(cast(derived_race='Race Not Available' as double)) from kept), 6) as race_not_reported_share from r, f")
def _(df):
    rates = A.group_rates(df, "derived_race")
    ref = rates.where(F.col("applications") >= 100).agg(F.min(F.struct("denial_rate", "group_value")).alias("r"))
    gap = F.when((F.col("applications") >= 100) & (F.col("group_value") != F.col("r.group_value")), F.round(100 * (F.col("denial_rate") - F.col("r.denial_rate")), 6))
    unknown = F.round(F.sum(F.when(F.col("group_value") == "Race Not Available", F.col("applications"))) / F.sum("applications"), 6)
    one = ref.crossJoin(rates.agg(F.coalesce(unknown, F.lit(0.0)).alias("race_not_reported_share")))
    return rates.crossJoin(F.broadcast(one)).select("group_value", "applications", gap.alias("raw_gap_pp"), F.col("r.group_value").alias("reference_group"), "race_not_reported_share")  # one row


@query("a9_lender_controlled")
def _(df):
    top = _gaps(df).where("on_watch_list").orderBy(F.col("shrunk_gap_pp").desc(), "lei").limit(25)
    return M.lender_controlled_gaps(df, top, "derived_race", "BUILDING", "FURNITURE")


@query("a9_all_lenders")
def _(df):
    return M.lender_controlled_gaps(df, df.select("lei").where("lei is not null"), "derived_race", "BUILDING", "FURNITURE")


@query("a10_waterfall", WATER)
def _(df):
    return A.waterfall(df, ["not_purchased", "income_known", "decisions_only"])


def _drift_sql() -> str:
    num = {"loan_amount": NUM("loan_amount"), "income": "case when income<>'NA' then cast(income as double) end*1000.0", "loan_to_value_ratio": "case when loan_to_value_ratio not in ('NA','Exempt') then cast(loan_to_value_ratio as double) end", "property_value": NUM("property_value"), "debt_to_income_ratio": RANK}
    coded = ("loan_type", "loan_purpose", "lien_status", "occupancy_type", "preapproval")
    rows = " union all ".join([f"select cast(activity_year as int) as yr, '{c}' as col, cast({e} as double) as x, cast(null as varchar) as code from app" for c, e in num.items()] + [f"select cast(activity_year as int), '{c}', null, case when {c}<>'NA' then {c} end from app" for c in coded])
    return f"""+ yy as (select distinct cast(activity_year as int) as year_a from app), pp as (select * from (select year_a, lead(year_a) over (order by year_a) as year_b from yy) where year_b is not null),
 l as ({rows}), sd as (select year_a, year_b, col, x, code, yr=year_a as is_a from l join pp on yr=year_a or yr=year_b where x is not null or code is not null),
 ed as (select year_a, year_b, col, list_distinct(quantile_cont(x, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0])) as e from sd where x is not null group by all),
 es as (select year_a, year_b, col, list_sort(e) as e from ed), bn as (select s.year_a, s.year_b, s.col, is_a, case when x is null then code else cast(len(list_filter(e[2:len(e)-1], lambda z: z < x)) as varchar) end as bin, coalesce(len(e) >= 3, true) as ok from sd s left join es on s.year_a=es.year_a and s.col=es.col and s.x is not null),
 ct as (select year_a, year_b, col, bin, ok, cast(count(*) filter (where is_a) as double) as a, cast(count(*) filter (where not is_a) as double) as b from bn group by all), sh as (select *, sum(a) over w as ta, sum(b) over w as tb from ct window w as (partition by year_a, col)),
 ps as (select year_a, year_b, col, sum(case when ok and ta>0 and tb>0 then (greatest(a/ta,1e-4)-greatest(b/tb,1e-4))*ln(greatest(a/ta,1e-4)/greatest(b/tb,1e-4)) else 0 end) as psi from sh group by all)"""


DRIFT = _drift_sql()


@query("a11_drift", DRIFT + " select year_a, year_b, col as \"column\", round(psi, 6) as psi, psi > 0.2 as shifted from ps")
def _(df):
    return r6(D.drift(df), "psi")


@query("a12_drift_years", DRIFT + " select year_a, year_b, count(*) as columns_checked, count(*) filter (where psi > 0.2) as columns_shifted from ps group by 1, 2")
def _(df):
    return D.drift_counts(D.drift(df))


AUDIT_STEPS = {"raw": "true", "not_purchased": "action_taken <> '6'", "decisions_only": "action_taken in ('1','2','3')", "income_known": "income <> 'NA'", "lender_known": "lei is not null"}


def _audit_sql() -> str:
    names = ["raw", *A.FILTERS]
    fall = [f"select 'waterfall' as branch, '{n}' as name, count(*) as value from app where {' and '.join(AUDIT_STEPS[x] for x in names[: i + 1])}" for i, n in enumerate(names)]
    rest = [
        "select 'screen', status, count(*) from scr group by status", "select 'flagged', 'lenders', count(distinct lei) from scr where ratio < 0.8",
        "select 'drift', year_a || '-' || year_b, count(*) filter (where psi > 0.2) from ps group by year_a, year_b",
    ]
    return f"+ {SCREEN}, {DRIFT.lstrip('+ ')} " + " union all ".join(fall + rest)


@query("a13_audit", _audit_sql())
def _(df):
    return U.summary(U.from_cube(written(U.cube(df))))


@query("a13_merged_cubes", _audit_sql())
def _(df):
    # As if the years had arrived one file after the other: each counted alone, then added up.
    parts = [written(U.cube(df.where(w))) for w in ("activity_year < '1995'", "activity_year >= '1995' and activity_year < '1997'", "activity_year >= '1997'")]
    return U.summary(U.from_cube(written(U.merged(*parts))))


# Models ---------------------------------------------------------------------------------
@query("r1_features", f" select app_id, {NUM('loan_amount')} as loan_amount, {INC} as income, cast({RANK} as double) as debt_to_income_rank, cast(loan_type='1' as double) as loan_type_1, cast(occupancy_type='2' as double) as occupancy_type_2, cast(action_taken='3' as int) as y from app where action_taken in ('1','2','3')")
def _(df):
    rows = A.keep(df, "decisions_only")
    f = M.feature_columns(rows)
    return rows.select("app_id", *(f[n].alias(n) for n in ("loan_amount", "income", "debt_to_income_rank", "loan_type_1", "occupancy_type_2")), C.denied().alias("y"))


@query("r2_logistic")
def _(df):
    train, test, _ = M.prepared(df, 2000)
    return M.scores(M.logistic(train, train.count()), test).select("app_id", "y", "score")


@query("r3_boosted")
def _(df):
    train, test, scaler = M.prepared(df, 2000)
    return M.scores(M.boosted(M.missing_as_nan(train, scaler)), M.missing_as_nan(test, scaler)).select("app_id", "y", "score")


@query("r4_base_rate", " select app_id, (select round(avg(cast(action_taken='3' as double)), 6) from app where action_taken in ('1','2','3') and cast(activity_year as int) < 2000) as score from app where action_taken in ('1','2','3') and cast(activity_year as int) >= 2000")
def _(df):
    train, test = M.time_split(A.keep(df, "decisions_only"), 2000)
    return test.select("app_id", F.lit(round(M.base_rate(train), 6)).alias("score"))


@query("r5_paired_evaluation")
def _(df):
    return M.evaluate(df, 2000)


@query("r6_seed_table")
def _(df):
    return P.summary_over_seeds(M.seed_table(df, 2000, 1_500_000), "challenger", "auc")


@query("r7_cutoff", DEMO + ", l as (select list_sort(list(score)) as s, (1.0-avg(y))*(count(*)-1) as p, count(*) as n from demo) select round(s[cast(floor(p) as int)+1] + (p-floor(p))*(s[least(cast(floor(p) as int)+2, n)] - s[cast(floor(p) as int)+1]), 6) as cutoff from l")
def _(df):
    rows = demo_scores(df)
    rate = rows.agg(F.avg("y")).first()[0]
    return r6(S.order_statistics(rows, F.col("score"), {"cutoff": 1.0 - rate}).drop("n"), "cutoff")


@query("r8_reweighing", WEIGHTS + " select g, y, round(cast(weight as double), 6) as weight from w")
def _(df):
    return r6(T.reweighing(demo_scores(df)), "weight")


@query("r9_constrained_round", DEMO + f", e as (select g from demo group by g having count(*) >= 100 and {ELIGIBLE}), r as (select g, avg(cast(score < 0.75 as double)) as rate from demo where g in (select g from e) group by g), w as (select app_id, y, case when rate is null then 1.0 when y=0 then exp(2.0*(0.6-rate)) else 1.0/exp(2.0*(0.6-rate)) end as w from demo left join r using (g)) select app_id, round(w/(select avg(w) from w), 6) as weight from w")
def _(df):
    rows = demo_scores(df).withColumn("weight", F.lit(1.0))
    groups = M.eligible_groups(rows.withColumnRenamed("g", "gv"), "gv")
    return T.constrained_round(rows, 0.75, 0.6, groups).select("app_id", F.round("weight", 6).alias("weight"))


@query("r10_group_cutoffs", DEMO + f" select g, round(quantile_cont(score, 0.7), 6) as cutoff from demo group by g having count(*) >= 100 and {ELIGIBLE}")
def _(df):
    return r6(T.group_cutoffs(demo_scores(df), 0.3), "cutoff")


@query("r11_decide", DEMO + " select app_id, cast(score < 0.75 as int) as approve from demo")
def _(df):
    return T.decide(demo_scores(df), 0.75).select("app_id", "approve")


MEASURE = DEMO + f", e as (select g from demo group by g having count(*) >= 100 and {ELIGIBLE}), d as (select *, cast(score < 0.75 as int) as approve from demo), r as (select g, avg(approve) as rate from d where g in (select g from e) group by g), m as (select avg(cast(approve = 1-y as double))*100 as accuracy_pct, avg(approve) as approval_rate, coalesce(avg(principal) filter (where approve=1), 0) as mp, coalesce(median(principal) filter (where approve=1), 0) as med from d) select round(accuracy_pct, 6) as accuracy_pct, round(approval_rate, 6) as approval_rate, round(mp, 4) as mean_principal, round(med, 4) as median_principal, (select round((max(rate)-min(rate))*100, 6) from r) as approval_gap_pp, (select arg_max(g, (rate, g)) from r) as high_group, (select arg_min(g, (rate, g)) from r) as low_group, round(approval_rate*1000*(4000.0-0.02*0.4*mp), 2) as margin_per_1000 from m"


def _measured(df):
    rows = written(demo_scores(df))  # for the groups, the counts and the median
    return T.measure(T.decide(rows, 0.75), "cut", M.eligible_groups(rows.withColumnRenamed("g", "gv"), "gv"))


@query("r12_measure", MEASURE)
def _(df):
    out = r6(_measured(df), "accuracy_pct", "approval_rate", "approval_gap_pp").drop("technique")
    return out.withColumns({"mean_principal": F.round("mean_principal", 4), "median_principal": F.round("median_principal", 4), "margin_per_1000": F.round("margin_per_1000", 2)})


@query("r13_compare_techniques")
def _(df):
    return T.compare(df, 2000)


CUTS = "+ o as (select activity_year as run, case derived_race when 'FURNITURE' then 'baseline' else derived_race end as technique, 100*avg(cast(action_taken='3' as double)) as gap, 100*avg(cast(action_taken='1' as double)) as acc from app group by 1, 2), b as (select run, gap as bg, acc as ba from o where technique='baseline'), c as (select technique, case when bg > 0 then (bg-gap)/bg*100 end as cut, acc-ba as dacc from o join b using (run)) select technique, round(min(cut),6) as cut_low, round(max(cut),6) as cut_high, round(min(dacc),6) as accuracy_low, round(max(dacc),6) as accuracy_high from c group by 1"


@query("r14_frontier", CUTS)
def _(df):
    name = F.when(F.col("derived_race") == "FURNITURE", "baseline").otherwise(F.col("derived_race"))
    runs = df.groupBy("activity_year", name.alias("technique")).agg((100 * F.avg(C.denied())).alias("gap"), (100 * F.avg((F.col("action_taken") == "1").cast("double"))).alias("acc"))
    base = runs.where("technique = 'baseline'").select("activity_year", F.col("gap").alias("bg"), F.col("acc").alias("ba"))
    cuts = runs.join(F.broadcast(base), "activity_year")  # a row per run
    cuts = cuts.select("technique", F.when(F.col("bg") > 0, (F.col("bg") - F.col("gap")) / F.col("bg") * 100).alias("gap_cut_pct"), (F.col("acc") - F.col("ba")).alias("accuracy_change"))
    return r6(T.frontier(cuts), "cut_low", "cut_high", "accuracy_low", "accuracy_high")


RECOURSE = DEMO + f", grid(x) as (values {GRID}), rq as (select app_id, any_value(g) as g, min(x) filter (where round(1.0/(1.0+exp(-(2.0 - (inc+x)/100000.0 + principal/(inc+x)/2.0 + rank/20.0))), 9) < 0.6) as increase from demo, grid where y=1 group by app_id)"


def _recourse(df):
    return R.required_increase(demo_scores(df).where("y = 1"), demo_score, 0.6)


@query("r16_required_increase", RECOURSE + " select app_id, round(increase, 4) as increase from rq")
def _(df):
    return _recourse(df).select("app_id", F.round("increase", 4).alias("increase"))


@query("r17_recourse_by_group", RECOURSE + " select g, count(*) as denied, count(increase) as reachable, round(1.0 - count(increase)/count(*), 6) as unreachable_share, case when count(increase) >= 30 then round(median(increase), 4) end as median_increase from rq where increase is null or increase > 0 group by g")
def _(df):
    return r6(R.recourse_by_group(_recourse(df)), "unreachable_share").withColumn("median_increase", F.round("median_increase", 4))


DRAWS = f"""u as (select k, increase, (('0x' || substr(md5(app_id || ':' || k), 1, 8))::bigint + 0.5) / 4294967296.0 as u from rq, range(10) t(k) where increase > 0),
 w as (select k, increase, {" + ".join(f"cast(u > {e} as int)" for e in R.POISSON)} as w from u), n as (select k, unnest(range(w)), increase from w)"""


@query("r18_stability", RECOURSE + ", " + DRAWS + " select cast(k as int) as replicate, round(median(increase), 4) as median_increase from n group by k")
def _(df):
    return R.stability(_recourse(df)).withColumn("median_increase", F.round("median_increase", 4))


@query("r16_model_recourse")
def _(df):
    return R.study(df, 2000).select("app_id", "g", F.round("increase", 4).alias("increase"))


@query("r17_model_recourse")
def _(df):
    return R.recourse_by_group(R.study(df, 2000, lambda rows, n: M.boosted(rows)))


@query("r18_model_stability")
def _(df):
    return R.stability(R.study(df, 2000))


@query("r19_drivers", DEMO + ", m as (select avg(inc) as mi, avg(principal) as mp, avg(rank) as mr from demo), l as (select g, abs(0.00001*(inc-mi)) as a, abs(0.00002*(principal-mp)) as b, abs(0.05*(rank-mr)) as c from demo, m), s as (select g, count(*) as n, avg(a) as a, avg(b) as b, avg(c) as c from l group by g having count(*) >= 30), u as (select g, 'income' as parent, a as v, 'income' as label from s union all select g, 'loan_amount', b, 'loan amount' from s union all select g, 'debt_to_income_ratio', c, 'debts to income' from s) select g as group_value, parent, round(v, 6) as contribution, row_number() over (partition by g order by v desc, parent) as rank, label from u")
def _(df):
    found = R.drivers(demo_scores(df), {"inc": 0.00001, "principal": 0.00002, "rank": 0.05}, {"inc": "income", "principal": "loan_amount", "rank": "debt_to_income_ratio"}, "g")
    return r6(found, "contribution").withColumn("rank", F.col("rank").cast("bigint"))


@query("r19_driver_groups", DEMO + " select lei as group_value, count(*) as n, count(*) < 200 as excluded from demo group by 1")
def _(df):
    return R.driver_groups(demo_scores(df), "lei", 200)


@query("r19_model_drivers")
def _(df):
    train, test, scaler = M.prepared(df, 2000)
    return R.model_drivers(M.boosted(M.missing_as_nan(train, scaler)), M.missing_as_nan(test, scaler), scaler.names, "g")


@query("r20_race_probe")
def _(df):
    train, test, _ = M.prepared(df, 2000)
    rows = M.scores(M.logistic(train, train.count()), test).withColumnRenamed("score", "denial_score")
    return R.race_probe(rows.withColumn("y", (F.col("g") == "BUILDING").cast("double")))


def _one_auc(name: str, expr: str) -> str:
    return f"select '{name}' as feature, a from (with z as (select {expr} as s, cast(action_taken='3' as int) as y from kept where ({expr}) is not null), {AUC.format(rows='z')} select sum(pos*(below+neg/2.0))/(sum(pos)*1.0*sum(neg)) as a, count(*) as k from cum) where k > 1"


@query("r21_feature_auc", f"+ f as ({_one_auc('loan_amount', NUM('loan_amount'))} union all {_one_auc('income', INC)} union all {_one_auc('debt_to_income_rank', RANK)}) select feature, round(greatest(a, 1-a), 6) as auc from f")
def _(df):
    features = {"loan_amount": C.to_float("loan_amount"), "income": C.to_float("income") * 1000.0, "debt_to_income_rank": C.debt_to_income_rank(), "constant": F.lit(1.0)}
    return r6(S.feature_auc(A.keep(df, "not_purchased"), features, C.denied()), "auc")


@query("r22_network_score")
def _(df):
    train, test, scaler = M.prepared(df, 2000)
    return M.scores(M.network(train, len(scaler.names)), test).select("app_id", "y", "score")


@query("r22_network_probe")
def _(df):
    train, test, scaler = M.prepared(df, 2000)
    net = M.network(train, len(scaler.names))
    rows = M.scores(net, test.where(F.col("g").isin("BUILDING", "FURNITURE"))).withColumnRenamed("score", "denial_score")
    return R.network_probe(net, rows.withColumn("y", (F.col("g") == "BUILDING").cast("double")), [len(scaler.names), 64, 32, 2])


@query("r23_probe_summary", RUNS + ", p as (select a.technique, a.v - b.v as v from runs a join runs b on a.seed=b.seed and b.technique='FURNITURE') select technique, round(avg(v),4) as mean, round(stddev_samp(v),4) as sd, round(min(v),4) as low, round(max(v),4) as high from p group by 1")
def _(df):
    runs = _runs(df)
    base = runs.where("technique = 'FURNITURE'").select("seed", F.col("v").alias("b"))
    paired = runs.join(F.broadcast(base), "seed").select("technique", (F.col("v") - F.col("b")).alias("v"))  # a row per seed
    return P.summary_over_seeds(paired, "technique", "v")


@query("r23_probe_runs")
def _(df):
    train, test, _ = M.prepared(df, 2000)
    rows = M.scores(M.logistic(train, train.count()), test).withColumnRenamed("score", "denial_score")
    return R.probe_summary(R.probe_runs(rows.withColumn("y", (F.col("g") == "BUILDING").cast("double"))))


@query("r23_top_counts", "+ runs as (select state_code as feature, activity_year as seed, avg(cast(action_taken='3' as double)) - 0.25 as v from app group by 1, 2), k as (select *, row_number() over (partition by seed order by round(abs(v), 9) desc, feature) as place from runs) select feature, count(*) as runs, count(*) filter (where place <= 5) as top, round(avg(v), 6) as mean from k group by 1")
def _(df):
    runs = df.groupBy(F.col("state_code").alias("feature"), F.col("activity_year").alias("seed")).agg(F.round(F.avg(C.denied()) - 0.25, 9).alias("v"))
    return r6(R.top_counts(runs, "feature", "v"), "mean")


# Verification -------------------------------------------------------------------------------
_BY = ("derived_race", "derived_ethnicity", "derived_sex")
#: The second route in SQL: grouping sets, and ranks by a self-join instead of windows.
RECOUNT = "b as (select lei, case " + " ".join(f"when grouping({c}) = 0 then '{c}'" for c in _BY) + " end as group_column, case " + " ".join(f"when grouping({c}) = 0 then {c}" for c in _BY) + f" end as group_value, {RATE} from kept group by grouping sets (" + ", ".join(f"(lei, {c})" for c in _BY) + "))"
RESCREEN = RECOUNT.replace("b as (", "b0 as (", 1) + """, b1 as (select *, 1 - cast(denials as double)/applications as approval_rate from b0),
 best as (select lei, group_column, max(approval_rate) as br from b1 where applications >= 100 group by all),
 again as (select b1.*, case when applications < 100 or br is null then 'SUPPRESSED' when br = 0 then 'UNDEFINED' else 'OK' end as status, case when applications >= 100 and br <> 0 then approval_rate/br end as ratio from b1 left join best using (lei, group_column))"""
PARITY = """select count(*) filter (where b.lei is null) as only_left, count(*) filter (where a.lei is null) as only_right,
 count(*) filter (where a.lei is not null and b.lei is not null and not ({same})) as mismatched, count(*) filter (where {same}) as matched
 from a full join {b} b on a.lei = b.lei and a.group_column = b.group_column and a.group_value is not distinct from b.group_value"""


@query("v1_parity_exact", f"+ a as (select lei, group_column, group_value, {RATE} from {LONG} group by all), {RECOUNT} " + PARITY.format(b="b", same="a.applications = b.applications and a.denials = b.denials"))
def _(df):
    return V.table_parity(A.all_group_rates(A.keep(df, "lender_known")), V.recount(df), ["lei", "group_column", "group_value"], ["applications", "denials"])


SQL["v1_digest_parity"] = SQL["v1_parity_exact"]


@query("v1_digest_parity")
def _(df):
    return V.parity_by_digests(A.all_group_rates(A.keep(df, "lender_known")), V.recount(df), ["lei", "group_column", "group_value"], ["applications", "denials"])[0]


@query("v2_screen_parity", f"+ {SCREEN}, a as (select * from scr), {RESCREEN} " + PARITY.format(b="again", same="a.status = b.status and (a.ratio is not distinct from b.ratio or abs(a.ratio - b.ratio) <= 1e-12)"))
def _(df):
    keys = ["lei", "group_column", "group_value"]
    again = A.screened(A.with_rates(V.recount(df)), ("lei", "group_column"))
    return V.table_parity(A.lender_screen(df), again, keys, ["status", "ratio"], 1e-12)


@query("v3_flagged_parity", f"+ {SCREEN}, {RESCREEN}, m as (select x.lei as x, y.lei as y from (select distinct lei from scr where ratio < 0.8) x full join (select distinct lei from again where ratio < 0.8) y on x.lei = y.lei) select count(x) as left_size, count(y) as right_size, count(*) filter (where x is not null and y is not null) as both, count(*) filter (where x is null or y is null) as differ from m")
def _(df):
    again = A.screened(A.with_rates(V.recount(df)), ("lei", "group_column")).where("flagged")
    return V.set_parity(A.flagged_lenders(A.lender_screen(df)), again, "lei")


@query("v4_recount", f" select lei, group_column, group_value, {RATE} from {LONG} group by all")
def _(df):
    return V.recount(df)


@query("v5_totals", TOTALS)
def _(df):
    return V.totals_agree(df, ["state_code", "activity_year", "derived_sex", "loan_type"])


@query("v6_claims", "+ r as (select 'rows' as name, cast(count(*) as double) as value from app union all select 'lenders', cast(count(distinct lei) as double) from app) select name, value, name <> 'years' and value >= 10 as passes from (select * from r union all select 'colours', null)")
def _(df):
    results = V.facts(df).select(F.col("fact").alias("name"), "value").where("name in ('rows', 'lenders')")
    claims = df.sparkSession.createDataFrame([("rows", ">=", 10.0), ("lenders", ">=", 10.0), ("colours", ">=", 10.0)], "name string, op string, expected double")
    return V.claims_hold(results, claims).select("name", "value", F.when(F.col("value").isNotNull(), F.col("passes")).alias("passes"))


FACTS = ("rows", "count(*)"), ("lenders", "count(distinct lei)"), ("years", "count(distinct activity_year)"), ("first_year", "min(cast(activity_year as int))"), ("last_year", "max(cast(activity_year as int))"), ("not_available_share", "round(avg(cast(derived_race='Race Not Available' as double)), 6)")


@query("v7_facts", " union all ".join(f"select '{n}' as fact, cast({e} as double) as value, 'counted' as basis from app" for n, e in FACTS) + " union all select 'features', 16.0, 'declared'")
def _(df):
    return r6(V.facts(df), "value")
