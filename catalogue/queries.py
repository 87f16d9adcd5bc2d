"""One callable (spark, folder) -> DataFrame per operator."""

from pyspark.sql import Window, functions as F

from retailspark import columns as C
from retailspark.functions import cut, days_between, parse_day
from retailspark.operators import aggregates as agg
from retailspark.operators import baskets as bk
from retailspark.operators import bayes as nb
from retailspark.operators import evaluation as ev
from retailspark.operators import filters as flt
from retailspark.operators import joins as jn
from retailspark.operators import quantiles as qt
from retailspark.operators import rules as rl
from retailspark.operators import split as sp
from retailspark.operators import windows as wd
from retailspark.plans import churn as ch
from retailspark.plans import rfm as rf
from retailspark.plans import trees as tr
from retailspark.session import materialise, scratch_path
from retailspark.sources import (
    DATASET,
    invalid_counts,
    load_dataset,
    null_tokens,
    read_baskets,
    read_delimited,
    star,
    write_baskets,
    write_delimited,
)

from . import params as P

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def text(*names):
    return [F.col(n).cast("string").alias(n) for n in names]


def number(*names):
    return [F.col(n).cast("double").alias(n) for n in names]


def rounded(digits, *names):
    return [F.round(F.col(n).cast("double"), digits).alias(n) for n in names]


def joined(name):
    return F.array_join(name, ",").alias(name)


# --- sources ---------------------------------------------------------------------------------


@query
def delimited_tickets(spark, folder):
    path = scratch_path(spark, "tickets")
    write_delimited(star.tickets(spark, folder), path)
    lines = read_delimited(spark, path, C.TICKET_SCHEMA, tokens=("NA", ""))
    return lines.groupBy(C.CUSTOMER).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(C.GROSS).cast("double").alias("gross"),
        F.min(C.DAY).cast("string").alias("first_day"),
        F.max(C.MOMENT).cast("date").cast("string").alias("last_day"),
        F.sum(C.DIRECTION).alias("direction"),
    )


@query
def delimited_documents(spark, folder):
    """Texts with quotes, separators and line breaks, through a file and back."""
    path = scratch_path(spark, "documents")
    docs = star.table(spark, folder, "documents").select("doc_id", "text", "source")
    hard = F.concat(F.lit('"; '), "text", F.lit('\n"";'), "source")
    write_delimited(docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, hard).otherwise(F.col("text"))), path)
    back = read_delimited(spark, path, "doc_id long, text string, source string", multi_line=True)
    return back.select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("digest"), "source")


@query
def delimited_header_orders(spark, folder):
    """A folder whose files name the same columns in two orders."""
    path = scratch_path(spark, "accounts")
    people = star.accounts(spark, folder)
    write_delimited(people.filter(F.col(C.CUSTOMER) % 2 == 0), path)
    swapped = people.filter(F.col(C.CUSTOMER) % 2 != 0).select(C.JOB, C.CUSTOMER, C.ADDRESS)
    write_delimited(swapped, path, mode="append")
    lines = read_delimited(spark, path, C.ACCOUNT_SCHEMA, headers="per_file")
    return lines.select(C.CUSTOMER, C.ADDRESS, C.JOB)


@query
def invalid_values(spark, folder):
    """Values of each column that are no numbers or days, counted instead of raised."""
    path = scratch_path(spark, "orders")
    orders = star.table(spark, folder, "orders")
    amount = F.when(F.col("o_orderkey") % 5 == 0, "1.234,50").otherwise(F.col("o_totalprice").cast("string"))
    day = F.col("o_orderdate").cast("date").cast("string")
    day = F.when(F.col("o_orderkey") % 7 == 0, "02/01/2019").otherwise(day)
    write_delimited(orders.select("o_orderkey", amount.alias("amount"), day.alias("day")), path)
    return invalid_counts(spark, path, "o_orderkey long, amount decimal(18,2), day date")


@query
def null_tokens_in_text(spark, folder):
    people = star.table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return null_tokens(people, ("BUILDING", ""), ["c_mktsegment"])


@query
def dataset_tables(spark, folder):
    home = scratch_path(spark, "dataset")
    people = star.table(spark, folder, "customer")
    events = star.table(spark, folder, "events")
    made = {
        "loyalty": star.loyalty(spark, folder, P.REF),
        "account": star.accounts(spark, folder),
        "address": star.addresses(spark, folder),
        "privacy": people.select(F.col("c_custkey").alias(C.CUSTOMER), "c_name"),
        "campaign": star.table(spark, folder, "region"),
        "campaign_event": events.select("event_id", "user_id", "event_type"),
        "ticket_line": star.tickets(spark, folder),
    }
    for name, df in made.items():
        write_delimited(df, f"{home}/{DATASET[name].file}.csv")
    parts = None
    for name, df in load_dataset(spark, home).items():
        width = F.lit(len(df.columns)).alias("columns")
        one = df.select(
            F.lit(name).alias("name"), width, sum(F.when(F.col(c).isNull(), 0).otherwise(1) for c in df.columns).alias("v")
        )
        one = one.groupBy("name", "columns").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("filled"))
        parts = one if parts is None else parts.unionByName(one)
    return parts


@query
def basket_files(spark, folder):
    path = scratch_path(spark, "baskets")
    write_baskets(type_baskets(spark, folder), path)
    back = read_baskets(spark, path)
    return back.groupBy(F.array_join("items", ",").alias("items")).agg(F.count(F.lit(1)).alias("n"))


# --- filters and projections ------------------------------------------------------------------


def day_lines(df):
    return df.select(C.CUSTOMER, C.TICKET, C.ARTICLE, *text(C.DAY), C.DIRECTION, *number(C.GROSS, C.DISCOUNT))


@query
def in_window(spark, folder):
    lines = star.tickets(spark, folder)
    return day_lines(flt.in_window(lines, C.MOMENT, P.LOOKBACK, P.REF, closed="neither"))


@query
def window_ends(spark, folder):
    days = star.table(spark, folder, "orders").select(F.col("o_orderdate").cast("date").alias(C.DAY), "o_orderkey")
    parts = None
    for closed in ("left", "right", "both", "neither"):
        one = flt.in_window(days, C.DAY, P.REF, P.HOLDOUT_END, closed)
        one = one.agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("key_sum"))
        one = one.select(F.lit(closed).alias("closed"), "n", "key_sum")
        parts = one if parts is None else parts.unionByName(one)
    open_end = flt.in_window(days, C.DAY, P.START, None, "neither")
    open_end = open_end.agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("key_sum"))
    return parts.unionByName(open_end.select(F.lit("after").alias("closed"), "n", "key_sum"))


@query
def purchases_only(spark, folder):
    return day_lines(flt.purchases_only(star.tickets(spark, folder)))


@query
def latest_rows(spark, folder):
    orders = star.table(spark, folder, "orders")
    return flt.latest_rows(orders, "o_orderdate").select(
        "o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").cast("string").alias("o_orderdate")
    )


@query
def active_only(spark, folder):
    lines = flt.in_window(star.tickets(spark, folder), C.MOMENT, P.START, None, "neither")
    found = flt.active_only(agg.recency(lines, P.AS_OF), P.MAX_DAYS)
    return found.select(C.CUSTOMER, *text(C.LAST_PURCHASE), C.RECENCY)


@query
def min_value(spark, folder):
    values = agg.monetary(star.tickets(spark, folder))
    return flt.min_value(values, C.MONETARY, "1000000").select(C.CUSTOMER, *number(C.MONETARY))


@query
def projected_columns(spark, folder):
    orders = star.table(spark, folder, "orders")
    return flt.project(
        orders,
        drop=["o_orderstatus"],
        casts={"o_totalprice": "decimal(18,1)"},
        copies={"priority": "o_orderpriority"},
        constants={"unit": "EUR"},
        rename={"o_custkey": "customer_id"},
        keep=["customer_id", "o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice"), "priority", "unit"],
    )


def carded_customers(spark, folder):
    return jn.enrich(star.accounts(spark, folder), star.loyalty(spark, folder, P.EARLY), C.CUSTOMER, [C.CARD])


@query
def complete_cases(spark, folder):
    return flt.complete_cases(carded_customers(spark, folder))


# --- joins ------------------------------------------------------------------------------------


@query
def restrict_to(spark, folder):
    lines = flt.in_window(star.tickets(spark, folder), C.MOMENT, P.START, None, "neither")
    active = flt.active_only(agg.recency(lines, P.AS_OF), P.MAX_DAYS)
    return day_lines(jn.restrict_to(lines, active))


@query
def assemble(spark, folder):
    lines = star.tickets(spark, folder)
    whole = jn.assemble(C.CUSTOMER, agg.recency(lines, P.AS_OF), agg.frequency(lines), agg.monetary(lines))
    return whole.select(C.CUSTOMER, *text(C.LAST_PURCHASE), C.RECENCY, C.VISITS, *number(C.MONETARY))


@query
def flag_members(spark, folder):
    people = star.accounts(spark, folder).select(C.CUSTOMER)
    recent = flt.in_window(star.tickets(spark, folder), C.MOMENT, P.REF, P.HOLDOUT_END, "left")
    return jn.flag_members(people, flt.purchases_only(recent))


@query
def enrich(spark, folder):
    return carded_customers(spark, folder)


@query
def enrich_via(spark, folder):
    buyers = agg.distinct_keys(star.tickets(spark, folder))
    return jn.enrich_via(buyers, star.accounts(spark, folder), star.addresses(spark, folder, "n_name"))


# --- aggregations -----------------------------------------------------------------------------


@query
def recency(spark, folder):
    found = agg.recency(star.tickets(spark, folder), P.AS_OF)
    return found.select(C.CUSTOMER, *text(C.LAST_PURCHASE), C.RECENCY)


@query
def frequency(spark, folder):
    return agg.frequency(star.tickets(spark, folder))


@query
def frequency_approx(spark, folder):
    return agg.frequency(star.tickets(spark, folder), method="approx")


@query
def frequency_approx_bound(spark, folder):
    """Customers whose approximate count lies within five standard errors of the exact one."""
    lines = star.tickets(spark, folder)
    near = agg.frequency(lines, method="approx").withColumnRenamed(C.VISITS, "near")
    both = agg.frequency(lines).join(near, C.CUSTOMER)
    within = F.abs(F.col("near") - F.col(C.VISITS)) <= 5 * 0.05 * F.col(C.VISITS)
    return both.select(C.CUSTOMER, within.cast("int").alias("within"))


@query
def monetary(spark, folder):
    return agg.monetary(star.tickets(spark, folder)).select(C.CUSTOMER, *number(C.MONETARY))


@query
def spend(spark, folder):
    return agg.spend(star.tickets(spark, folder)).select(C.CUSTOMER, *number(C.GROSS, C.DISCOUNT, C.SPEND))


@query
def distinct_keys(spark, folder):
    return agg.distinct_keys(star.tickets(spark, folder))


@query
def level_counts(spark, folder):
    names = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "UNKNOWN"]
    return agg.level_counts(star.accounts(spark, folder), C.JOB, names)


@query
def cross_counts(spark, folder):
    return agg.cross_counts(star.table(spark, folder, "orders"), "o_orderpriority", "o_orderstatus")


@query
def cross_counts_wide(spark, folder):
    orders = star.table(spark, folder, "orders")
    return agg.cross_counts(
        orders, "o_orderpriority", "o_orderstatus", pivot="o_orderstatus", pivot_values=["F", "O", "P"]
    )


VENTILES = [i / 20 for i in range(21)]


@query
def quantiles(spark, folder):
    values = agg.monetary(star.tickets(spark, folder))
    return qt.quantiles(values, C.MONETARY, VENTILES).select("prob", *rounded(4, "value"))


@query
def quantiles_of_lines(spark, folder):
    lines = star.table(spark, folder, "lineitem")
    table = qt.quantile_table(lines, {"l_extendedprice": VENTILES, "l_quantity": [0.0, 0.25, 0.75, 1.0]})
    return table.select("measure", "prob", *rounded(4, "value"))


@query
def quantiles_approx(spark, folder):
    values = agg.monetary(star.tickets(spark, folder))
    return qt.quantiles(values, C.MONETARY, VENTILES, method="approx")


@query
def quantiles_approx_bound(spark, folder):
    """Whether each approximate quantile has a rank within the declared error of its own."""
    values = materialise(agg.monetary(star.tickets(spark, folder)).select(F.col(C.MONETARY).cast("double").alias("v")))
    table = qt.quantiles(values, "v", VENTILES, method="approx")
    n = values.count()
    slack = n / qt.ACCURACY + 1
    rows = []
    for prob, value in table.select("prob", "value").collect():  # one row per ventile
        low, high = F.count_if(F.col("v") < value) - slack, F.count_if(F.col("v") <= value) + slack
        within = (low <= prob * n) & (high >= prob * n)
        rows.append(F.struct(F.lit(prob).alias("prob"), within.cast("int").alias("within")))
    return values.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def all_measures(spark, folder):
    return materialise(rf.customer_measures(star.tickets(spark, folder), P.AS_OF))


@query
def profile(spark, folder):
    table = qt.profile(all_measures(spark, folder), [C.RECENCY, C.VISITS, C.MONETARY])
    return table.select("measure", *rounded(4, "min", "q1", "median", "mean", "q3", "max"))


@query
def distribution(spark, folder):
    table = qt.distribution(all_measures(spark, folder), [C.RECENCY, C.VISITS, C.MONETARY], bins=20)
    return table.select("measure", "bin", *rounded(4, "lo", "hi"), "n", *rounded(10, "density"))


@query
def article_sales(spark, folder):
    return agg.article_sales(star.tickets(spark, folder), 10)


# --- windows and sorts ------------------------------------------------------------------------


@query
def repurchase_gaps(spark, folder):
    return wd.repurchase_gaps(star.tickets(spark, folder)).select(C.CUSTOMER, *text("day"), "gap")


@query
def repurchase_quantiles(spark, folder):
    gaps = wd.repurchase_gaps(star.tickets(spark, folder))
    return wd.repurchase_quantiles(gaps).select("prob", *rounded(6, "value"))


@query
def repurchase_curve(spark, folder):
    gaps = wd.repurchase_gaps(star.tickets(spark, folder))
    return wd.repurchase_curve(gaps).select("gap", "n", *rounded(9, "share"))


@query
def ordered_customers(spark, folder):
    return agg.ordered(agg.frequency(star.tickets(spark, folder)), C.VISITS, ties=[C.CUSTOMER])


# --- scalar expressions -----------------------------------------------------------------------


@query
def parsed_days(spark, folder):
    orders = star.table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    written = orders.select(
        "o_orderkey",
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("padded"),
        F.date_format("o_orderdate", "d/M/yyyy").alias("short"),
    )
    return written.select(
        "o_orderkey",
        parse_day(F.col("padded")).cast("string").alias("padded_day"),
        parse_day(F.col("short")).cast("string").alias("short_day"),
    )


@query
def day_differences(spark, folder):
    orders = star.table(spark, folder, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    lines = star.table(spark, folder, "lineitem").select("l_orderkey", F.col("l_shipdate").cast("date").alias("ship"))
    both = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return both.select("o_orderkey", days_between(F.col("ship"), F.col("day")).alias("days"))


@query
def joined_articles(spark, folder):
    lists = bk.article_lists(star.tickets(spark, folder))
    return lists.select(C.CUSTOMER, F.col(C.MOMENT).cast("date").cast("string").alias("day"), "items")


@query
def cut_right_closed(spark, folder):
    orders = star.table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return cut(orders, "o_totalprice", [1000.0, 100000.0, 300000.0, 500000.0], C.LEVELS, out="level")


@query
def cut_left_closed(spark, folder):
    lines = star.table(spark, folder, "lineitem").select("l_orderkey", "l_quantity")
    return cut(lines, "l_quantity", [1.0, 10.0, 25.0, 50.0], C.LEVELS, right=False, out="level")


@query
def cut_collapsed(spark, folder):
    groups = rf.rfm_groups(
        star.tickets(spark, folder), P.SHORT_START, P.AS_OF, P.MAX_DAYS, when=C.MOMENT, on_degenerate="collapse"
    )
    return groups.select(C.CUSTOMER, C.VISITS, C.FREQUENCY_GROUP)


# --- segmentation -----------------------------------------------------------------------------


def groups_of(spark, folder):
    return rf.rfm_groups(
        star.tickets(spark, folder), P.START, P.AS_OF, P.MAX_DAYS, when=C.MOMENT, on_degenerate="collapse"
    )


def table_of(spark, folder):
    return rf.with_value(groups_of(spark, folder))


def rfm_columns(df, *more):
    return df.select(
        C.CUSTOMER,
        C.VISITS,
        C.FREQUENCY_GROUP,
        *number(C.MONETARY),
        C.MONETARY_GROUP,
        *text(C.LAST_PURCHASE),
        C.RECENCY,
        C.RECENCY_GROUP,
        *more,
    )


@query
def rfm_table(spark, folder):
    return rfm_columns(table_of(spark, folder))


@query
def rf_segment(spark, folder):
    return rf.rfm_segments(table_of(spark, folder)).select(C.CUSTOMER, C.RECENCY_GROUP, C.FREQUENCY_GROUP, "RF")


@query
def rfm_class(spark, folder):
    return rf.rfm_segments(table_of(spark, folder)).select(C.CUSTOMER, "RF", C.MONETARY_GROUP, "RFM")


@query
def rfm_segments(spark, folder):
    return rfm_columns(rf.rfm_segments(table_of(spark, folder)), "RF", "RFM")


@query
def rfm_scores(spark, folder):
    scored = rf.rfm_scores(materialise(table_of(spark, folder)))
    return scored.select(
        C.CUSTOMER, "recency_score", "frequency_score", "monetary_score", "rfm_score"
    )


@query
def rfm_points(spark, folder):
    table = materialise(table_of(spark, folder))
    pairs = {"RM": (C.RECENCY, C.MONETARY), "FM": (C.VISITS, C.MONETARY), "RF": (C.RECENCY, C.VISITS)}
    parts = None
    for name, (x, y) in pairs.items():
        one = rf.rfm_pairs(table, x, y).select(F.lit(name).alias("plot"), C.CUSTOMER, *number("x", "y"))
        parts = one if parts is None else parts.unionByName(one)
    return parts


@query
def rfm_raster(spark, folder):
    return rf.rfm_pairs(all_measures(spark, folder), C.RECENCY, C.MONETARY, grid=25)


@query
def share_bands(spark, folder):
    bands = rf.rfm_bands(groups_of(spark, folder))
    return bands.select("measure", "category", "n", *rounded(9, "fraction", "ymin", "ymax", "labelPosition"), "label")


@query
def rfm_report(spark, folder):
    return rf.rfm_report_rows(materialise(groups_of(spark, folder)))


# --- churn ------------------------------------------------------------------------------------


@query
def churn_features(spark, folder):
    found = ch.churn_features(star.tickets(spark, folder), P.REF, P.LOOKBACK, when=C.MOMENT)
    return found.select(C.CUSTOMER, C.RECENCY, *number(C.SPEND), C.PURCHASES)


@query
def churn_labels(spark, folder):
    lines = star.tickets(spark, folder)
    features = ch.churn_features(lines, P.REF, P.LOOKBACK, when=C.MOMENT)
    return ch.churn_label(features, lines, P.REF, P.HOLDOUT_END, when=C.MOMENT).select(C.CUSTOMER, C.CHURN)


def churn_rows(spark, folder):
    return ch.churn_dataset(
        star.tickets(spark, folder),
        star.accounts(spark, folder),
        star.loyalty(spark, folder, P.REF),
        star.addresses(spark, folder),
        P.REF,
        P.LOOKBACK,
        P.HOLDOUT_END,
        when=C.MOMENT,
        unique=False,  # the star's tables have one row per key
    )


@query
def churn_dataset(spark, folder):
    return churn_rows(spark, folder).select(
        C.CUSTOMER, C.RECENCY, *number(C.SPEND), C.PURCHASES, C.CHURN, C.JOB_CLEAN, C.CARD, C.REGION
    )


def split_of(rows, exact=True):
    return sp.assign_split(rows, C.CHURN, C.CUSTOMER, P.SPLIT, P.SEED, exact)


@query
def stratified_split(spark, folder):
    marked = split_of(materialise(churn_rows(spark, folder)))
    return marked.select(C.CUSTOMER, C.CHURN, F.col("is_train").cast("int").alias("is_train"))


@query
def hashed_split(spark, folder):
    marked = split_of(churn_rows(spark, folder), exact=False)
    return marked.select(C.CUSTOMER, C.CHURN, F.col("is_train").cast("int").alias("is_train"))


def encoded_split(spark, folder):
    return ch.training_tables(churn_rows(spark, folder), P.SPLIT, P.SEED)


@query
def encoded_categories(spark, folder):
    encoder, rows = ch.encode(materialise(churn_rows(spark, folder)))
    terms = ch.term_names(encoder)
    values = ch.vector_to_array("features")
    pairs = F.arrays_zip(F.array(*[F.lit(t) for t in terms]).alias("term"), values.alias("value"))
    long = rows.select(F.inline(pairs)).toDF("term", "value")
    return long.groupBy("term").agg(F.count_if(F.col("value") != 0).alias("n"))


@query
def encoded_one_level(spark, folder):
    """The same with a category that has one level only."""
    rows = materialise(churn_rows(spark, folder).withColumn(C.CARD, F.lit("ONE")))
    encoder, encoded = ch.encode(rows)
    width = F.size(ch.vector_to_array("features"))
    return encoded.groupBy(width.alias("features")).agg(
        F.count(F.lit(1)).alias("n"), F.lit(len(ch.term_names(encoder))).alias("terms")
    )


def rounded_predictions(df):
    return df.select(C.CUSTOMER, "label", "prediction", *rounded(6, "probability"))


@query
def decision_tree(spark, folder):
    encoder, train, test = encoded_split(spark, folder)
    return rounded_predictions(ch.predict(ch.decision_tree(train, encoder), test))


@query
def tree_rules(spark, folder):
    encoder, train, _ = encoded_split(spark, folder)
    return ch.tree_rules(ch.decision_tree(train, encoder), spark)


@query
def tree_importances(spark, folder):
    encoder, train, _ = encoded_split(spark, folder)
    return ch.tree_importances(ch.decision_tree(train, encoder), spark)


@query
def tree_complexity(spark, folder):
    encoder, train, _ = encoded_split(spark, folder)
    return ch.tree_complexity(train, encoder)


@query
def random_forest(spark, folder):
    encoder, train, test = encoded_split(spark, folder)
    return rounded_predictions(ch.predict(ch.random_forest(train, encoder), test))


@query
def logistic_regression(spark, folder):
    _, train, test = encoded_split(spark, folder)
    return rounded_predictions(ch.predict(ch.logistic_regression(train), test))


@query
def tree_leaf_shares(spark, folder):
    """All leaves together: training rows, positives, what the leaves' probabilities give, and leaves that are off."""
    encoder, train, _ = encoded_split(spark, folder)
    leaves = ch.leaf_shares(ch.decision_tree(train, encoder), train)
    off = F.abs(F.col("probability") - F.col("positives") / F.col("n")) > 1e-9
    return leaves.agg(
        F.sum("n").alias("n"),
        F.sum("positives").cast("long").alias("positives"),
        F.round(F.sum(F.col("n") * F.col("probability")), 6).alias("fitted"),
        F.count_if(off).alias("leaves_off"),
    )


@query
def split_gains(spark, folder):
    _, train, _ = encoded_split(spark, folder)
    return tr.split_gains(train).withColumn("below", F.round("below", 6))


@query
def tree_pruning(spark, folder):
    encoder, train, test = encoded_split(spark, folder)
    return tr.tree_pruning(ch.decision_tree(train, encoder), train, test)


@query
def tree_pruning_ends(spark, folder):
    """The last subtree, which is the root alone, and subtrees that break the order of the sequence."""
    table = tree_pruning(spark, folder)
    last = F.struct("leaves", "train_errors", "test_errors", "train_rows", "test_rows")
    before = Window.orderBy("subtree")  # a row per leaf of one tree
    broken = (
        (F.lag("leaves").over(before) <= F.col("leaves"))
        | (F.lag("alpha").over(before) >= F.col("alpha"))
        | (F.lag("train_errors").over(before) > F.col("train_errors"))
    )
    ends = table.withColumn("broken", F.coalesce(broken, F.lit(False)))
    return ends.agg(F.max_by(last, "subtree").alias("last"), F.count_if("broken").alias("out_of_order")).select(
        "last.*", "out_of_order"
    )


@query
def forest_bags(spark, folder):
    _, train, _ = encoded_split(spark, folder)
    return tr.bag_sizes(tr.bagged_rows(train, P.BAGS, seed=P.SEED), P.BAGS)


@query
def forest_out_of_bag(spark, folder):
    encoder, train, _ = encoded_split(spark, folder)
    judged = tr.out_of_bag(train, encoder, P.BAGS, seed=P.SEED).where("judges > 0")
    return ev.confusion(judged)


@query
def logistic_totals(spark, folder):
    encoder, train, _ = encoded_split(spark, folder)
    totals = ch.fitted_totals(ch.logistic_regression(train), train, encoder)
    exact = totals.filter(~F.col("term").isin(*ch.NUMERIC))
    return exact.select("term", F.col("observed").cast("long").alias("observed"), *rounded(0, "fitted"))


@query
def logistic_summary(spark, folder):
    _, train, _ = encoded_split(spark, folder)
    table = ch.logistic_summary(train)
    return table.select(*rounded(3, "null_deviance"), "null_df", *rounded(6, "residual_deviance", "aic"), "residual_df")


@query
def logistic_null_deviance(spark, folder):
    _, train, _ = encoded_split(spark, folder)
    table = ch.logistic_summary(train)
    gap = F.col("aic") - F.col("residual_deviance") - 2 * (F.col("null_df") - F.col("residual_df") + 1)
    return table.select(*rounded(3, "null_deviance"), "null_df", F.round(F.abs(gap), 6).alias("aic_gap"))


@query
def predicted_rows(spark, folder):
    """Rows and positives that each model predicts for, and rows whose class is not that of its probability."""
    encoder, train, test = encoded_split(spark, folder)
    models = {
        "logistic_reg": ch.logistic_regression(train),
        "random_forest": ch.random_forest(train, encoder),
        "dec_tree": ch.decision_tree(train, encoder),
    }
    parts = None
    for name, model in models.items():
        off = F.col("prediction") != F.when(F.col("probability") > 0.5, "1").otherwise("0")
        one = ch.predict(model, test).agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("label") == "1").alias("positives"),
            F.count_if(off & (F.col("probability") != 0.5)).alias("classes_off"),
        )
        one = one.select(F.lit(name).alias("model"), "*")
        parts = one if parts is None else parts.unionByName(one)
    return parts


@query
def logistic_coefficients(spark, folder):
    encoder, train, _ = encoded_split(spark, folder)
    return ch.logistic_coefficients(train, encoder)


@query
def logistic_resampled(spark, folder):
    _, train, _ = encoded_split(spark, folder)
    return ch.resampled_accuracy(train)


def bayes_of(spark, folder):
    marked = materialise(split_of(materialise(churn_rows(spark, folder))))
    model = nb.fit_bayes(marked.filter("is_train"), C.CHURN, ch.NUMERIC, ch.CATEGORICAL)
    return model, nb.predict_bayes(model, marked.filter("not is_train"), C.CUSTOMER)


@query
def naive_bayes_parameters(spark, folder):
    model, _ = bayes_of(spark, folder)
    return model.parameters().select("class", "feature", "level", "parameter", *rounded(6, "value"))


@query
def naive_bayes(spark, folder):
    return rounded_predictions(bayes_of(spark, folder)[1])


@query
def confusion_counts(spark, folder):
    return ev.confusion(bayes_of(spark, folder)[1])


@query
def model_metrics(spark, folder):
    table = ev.metrics(bayes_of(spark, folder)[1])
    return table.select(
        "tp", "fp", "fn", "tn",
        *rounded(9, "accuracy", "recall", "specificity", "precision", "kappa", "no_information_rate", "f1"),
    )


@query
def confusion_report(spark, folder):
    table = ev.confusion_report(bayes_of(spark, folder)[1])
    return table.select(*rounded(9, *table.columns))


@query
def f1_score(spark, folder):
    return ev.f1(bayes_of(spark, folder)[1]).select(*rounded(9, "f1"))


@query
def bootstrap_accuracy(spark, folder):
    return ev.bootstrap_accuracy(bayes_of(spark, folder)[1], C.CUSTOMER).select("repeat", "n", *rounded(9, "accuracy"))


@query
def compare_models(spark, folder):
    encoder, train, test = encoded_split(spark, folder)
    bayes = nb.fit_bayes(train, C.CHURN, ch.NUMERIC, ch.CATEGORICAL)
    return ev.compare_models(
        {
            "naive_bayes": nb.predict_bayes(bayes, test, C.CUSTOMER),
            "logistic_reg": ch.predict(ch.logistic_regression(train), test),
            "random_forest": ch.predict(ch.random_forest(train, encoder), test),
            "dec_tree": ch.predict(ch.decision_tree(train, encoder), test),
        }
    )


# --- baskets and rules ------------------------------------------------------------------------


def type_baskets(spark, folder):
    return bk.baskets(star.tickets(spark, folder, article="p_type"))


@query
def baskets(spark, folder):
    return type_baskets(spark, folder).select(
        C.CUSTOMER, F.col(C.MOMENT).cast("date").cast("string").alias("day"), joined("items")
    )


def tickets_with_gaps(spark, folder):
    """Kinds of articles, missing on all lines of every ticket whose number five divides."""
    return star.tickets(spark, folder, article="p_type").withColumn(
        C.ARTICLE, F.when(F.col(C.TICKET) % 5 != 0, F.col(C.ARTICLE))
    )


@query
def basket_totals_with_gaps(spark, folder):
    """Number of baskets by three ways, some baskets having no article."""
    lines = materialise(bk.basket_lines(tickets_with_gaps(spark, folder)))
    sets = materialise(bk.baskets(tickets_with_gaps(spark, folder)))
    path = scratch_path(spark, "baskets")
    write_baskets(sets, path)
    ways = {
        "lines": bk.frequent_items(lines)[1],
        "sets": bk.itemsets(sets)[1],
        "pairs": rl.pair_counts(lines)[2],
        "files": read_baskets(spark, path).count(),
    }
    return spark.createDataFrame(list(ways.items()), "way string, baskets long")


@query
def pair_rules_with_gaps(spark, folder):
    lines = bk.basket_lines(tickets_with_gaps(spark, folder))
    return rule_columns(rl.pair_rules(lines, bk.KEYS, P.TYPE_SUPPORT, P.BRAND_CONFIDENCE), "count")


@query
def basket_summary(spark, folder):
    table = bk.basket_summary(materialise(lines_of(spark, folder, "p_type")))
    return table.select("section", "name", *rounded(9, "value"))


@query
def item_frequency(spark, folder):
    return bk.item_frequency(lines_of(spark, folder, "p_brand"), 10)


def lines_of(spark, folder, article="l_partkey"):
    return bk.basket_lines(star.tickets(spark, folder, article=article))


def type_rules(spark, folder):
    return materialise(rl.rules_of_lines(lines_of(spark, folder, "p_type"), bk.KEYS, P.TYPE_SUPPORT, P.TYPE_CONFIDENCE))


def rule_columns(df, *more):
    return df.select(
        joined("antecedent"), joined("consequent"), *rounded(9, "support", "confidence", "lift"), *more
    )


@query
def frequent_itemsets(spark, folder):
    sets, _ = bk.itemsets(materialise(type_baskets(spark, folder)), P.TYPE_SUPPORT)
    return sets.select(joined("items"), "freq")


@query
def association_rules(spark, folder):
    found = rl.rules_of_lines(lines_of(spark, folder, "p_type"), bk.KEYS, P.TYPE_SUPPORT, P.TYPE_CONFIDENCE)
    return rule_columns(found, "count")


@query
def rule_coverage(spark, folder):
    found = rl.rules_of_lines(lines_of(spark, folder, "p_type"), bk.KEYS, P.TYPE_SUPPORT, P.TYPE_CONFIDENCE)
    return found.select(joined("antecedent"), joined("consequent"), *rounded(9, "coverage"))


@query
def association_rules_of_sets(spark, folder):
    return rule_columns(rl.rules(type_baskets(spark, folder), P.TYPE_SUPPORT, P.TYPE_CONFIDENCE), "count")


@query
def association_rules_two_items(spark, folder):
    lines = lines_of(spark, folder, "p_brand")
    found = rl.rules_of_lines(lines, bk.KEYS, P.BRAND_SUPPORT, P.BRAND_CONFIDENCE, max_len=2)
    return rule_columns(found, "count")


@query
def pair_rules(spark, folder):
    lines = lines_of(spark, folder, "p_brand")
    return rule_columns(rl.pair_rules(lines, bk.KEYS, P.BRAND_SUPPORT, P.BRAND_CONFIDENCE), "count")


@query
def pair_rules_by_article(spark, folder):
    lines = lines_of(spark, folder)
    return rule_columns(rl.pair_rules(lines, bk.KEYS, P.ARTICLE_SUPPORT, P.ARTICLE_CONFIDENCE), "count")


@query
def sorted_rules(spark, folder):
    return rule_columns(rl.sort_rules(type_rules(spark, folder)))


@query
def rule_summary(spark, folder):
    return rl.rule_summary(type_rules(spark, folder)).select("section", "name", *rounded(9, "value"))


@query
def top_rules(spark, folder):
    return rule_columns(rl.top_rules(type_rules(spark, folder), "support", 10))


@query
def redundant_rules(spark, folder):
    flagged = rl.redundant(type_rules(spark, folder))
    return rule_columns(flagged, F.col("redundant").cast("int").alias("redundant"))


@query
def pruned_rules(spark, folder):
    return rule_columns(rl.sort_rules(rl.prune(type_rules(spark, folder)), "lift"))


@query
def rule_points(spark, folder):
    return rule_columns(rl.rule_points(rl.prune(type_rules(spark, folder)), 10))


@query
def rule_grid(spark, folder):
    cells = rl.rule_grid(rl.prune(type_rules(spark, folder)), 10)
    return cells.select("lhs", "rhs", *rounded(9, "lift", "support"))


@query
def rule_nodes(spark, folder):
    nodes, _ = rl.rule_edges(rl.prune(type_rules(spark, folder)), 10)
    return nodes.select("node", "kind", *rounded(9, "support", "lift"))


@query
def rule_edges(spark, folder):
    _, edges = rl.rule_edges(rl.prune(type_rules(spark, folder)), 10)
    return edges.select("source", "target", *rounded(9, "support", "lift"))
