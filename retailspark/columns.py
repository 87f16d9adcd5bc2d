"""Names and types of the retail data model."""

from pyspark.sql import types as T

CUSTOMER = "ID_CLI"
TICKET = "ID_SCONTRINO"
ARTICLE = "ID_ARTICOLO"
ADDRESS = "ID_ADDRESS"
DAY = "TIC_DATE"
MOMENT = "TIC_DATETIME"
DIRECTION = "DIREZIONE"
GROSS = "IMPORTO_LORDO"
DISCOUNT = "SCONTO"
JOB = "TYP_JOB"
JOB_CLEAN = "TYP_JOB_CLEAN"
CARD = "LAST_COD_FID"
REGION = "REGION"

LAST_PURCHASE = "LAST_PURCHASE"
RECENCY = "RECENCY"
VISITS = "N_TRANSAZIONI"
MONETARY = "MONETARY_VALUE"
RECENCY_GROUP = "RECENCY_GROUP"
FREQUENCY_GROUP = "FREQUENCY_GROUP"
MONETARY_GROUP = "MONETARY_GROUP"
SPEND = "SPESA"
PURCHASES = "TOT_PURCHASE"
CHURN = "CHURN"

LEVELS = ("LOW", "MEDIUM", "HIGH")

MONEY = T.DecimalType(18, 2)


def strings(*names):
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


TICKET_SCHEMA = T.StructType(
    [
        T.StructField(CUSTOMER, T.StringType()),
        T.StructField(TICKET, T.StringType()),
        T.StructField(ARTICLE, T.StringType()),
        T.StructField(DAY, T.DateType()),
        T.StructField(MOMENT, T.TimestampNTZType()),
        T.StructField(DIRECTION, T.IntegerType()),
        T.StructField(GROSS, MONEY),
        T.StructField(DISCOUNT, MONEY),
    ]
)
ACCOUNT_SCHEMA = strings(CUSTOMER, ADDRESS, JOB)
ADDRESS_SCHEMA = strings(ADDRESS, REGION)
LOYALTY_SCHEMA = strings(CUSTOMER, CARD)
