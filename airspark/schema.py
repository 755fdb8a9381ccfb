"""Column names, stored types and the fixed feature order."""

from __future__ import annotations

from pyspark.sql import types as T

STATION = "station_id"
TS = "ts"

POLLUTANTS = ["pm2_5", "pm10", "o3", "no2", "so2", "co"]

# Names used by the payload and by the table.
PAYLOAD_NAMES = {
    "pm10": "pm10",
    "pm2_5": "pm2_5",
    "ozone": "o3",
    "nitrogen_dioxide": "no2",
    "sulphur_dioxide": "so2",
    "carbon_monoxide": "co",
}

# The model's input order.
FEATURES = [
    "pm2_5", "pm10", "o3", "no2", "so2", "co",
    "pm2_5_lag1", "pm2_5_lag2", "pm2_5_lag3",
    "pm2_5_lag24", "pm2_5_lag48", "pm2_5_lag72",
    "diff_1h", "diff_24h", "diff_1h_acc",
    "recent_hour_avg",
    "pm2_5_rolling_mean_24h", "pm2_5_rolling_std_24h",
    "hour_sin", "hour_cos", "hour_raw",
    "month_sin", "month_cos", "month",
    "day",
    "is_weekend",
]
OPTIONAL_FEATURE = "aqi_change_rate"

# Display names and units of the constituents table.
CONSTITUENTS = [
    ("pm2_5", "PM2.5", "µg/m³"),
    ("pm10", "PM10", "µg/m³"),
    ("o3", "O₃", "µg/m³"),
    ("no2", "NO₂", "µg/m³"),
    ("so2", "SO₂", "µg/m³"),
    ("co", "CO", "µg/m³"),
]

FEATURE_TABLE = T.StructType(
    [T.StructField(STATION, T.IntegerType(), False), T.StructField(TS, T.TimestampNTZType(), False)]
    + [T.StructField(p, T.DoubleType()) for p in POLLUTANTS]
    + [
        T.StructField("hour", T.IntegerType()),
        T.StructField("day", T.IntegerType()),
        T.StructField("month", T.IntegerType()),
        T.StructField("aqi", T.IntegerType()),
        T.StructField("aqi_change_rate", T.DoubleType()),
        T.StructField("ingestion_timestamp", T.TimestampNTZType()),
    ]
)

PAYLOAD = T.StructType(
    [
        T.StructField(
            "hourly",
            T.StructType(
                [T.StructField("time", T.ArrayType(T.StringType()))]
                # Strings, so that one bad value does not void the whole array.
                + [T.StructField(n, T.ArrayType(T.StringType())) for n in PAYLOAD_NAMES]
            ),
        )
    ]
)
