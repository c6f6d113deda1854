"""Names, orders and limits that must equal those of existing meter files and models."""

# Column name candidates, in order of preference.
TIMESTAMP_FIRST = ["full_timestamp"]
TIMESTAMP_OTHER = ["timestamp", "time", "datetime"]
BUILDING = [
    "building_name", "building_id", "meter_id", "site", "household",
    "zone substation", "id", "customer_id", "customer",
]
BUILDING_SCORING = ["building_name", "meter_id", "site", "household", "zone substation"]
USAGE_NORM = [
    "usage_kwh_norm", "consumption_norm", "kwh_norm",
    "usage_kwh_normalised", "usage_kwh_normalized",
    "usage_normalised", "usage_normalized",
    "usage_norm", "normalized_usage", "normalised_usage",
]
USAGE_NORM_SCORING = ["usage_kwh_norm", "consumption_norm", "kwh_norm"]
USAGE_RAW = ["usage_kwh", "kwh", "consumption_kwh", "consumption"]
TEMPERATURE_NORM = [
    "apparent_temperature_norm", "normalized_temperature", "temperature_norm", "temp_norm",
]
TEMPERATURE_RAW = ["apparent_temperature"]
PRECIPITATION = ["precipitation", "rain", "precip"]
IS_DAY = ["is_day"]
IS_WEEKEND = ["is_weekend"]
IS_HOLIDAY = ["is_holiday"]
WEATHER_NEEDED = ["time", "apparent_temperature", "precipitation", "is_day"]

# Id columns of a wide meter file (every other column is a time slot).
WIDE_ID_COLUMNS = ["year", "zone substation", "date", "unit"]

# Canonical column order of each table.
READING_COLUMNS = [
    "building_name", "full_timestamp", "usage_kwh_norm", "apparent_temperature_norm",
    "precipitation", "is_day", "is_weekend", "is_holiday", "region",
]
WEATHER_JOINED_COLUMNS = [
    "building_name", "full_timestamp", "usage_kwh_norm", "apparent_temperature_norm",
    "precipitation", "is_day", "is_holiday", "is_weekend",
]
LONG_USAGE_COLUMNS = [
    "building_name", "full_timestamp", "usage_kwh", "season", "is_holiday", "is_weekend",
]
FEATURE_COLUMNS = [
    "building_name", "full_timestamp", "region", "region_id",
    "usage_kwh_norm_orig", "usage_pb",
    "apparent_temperature_norm", "temp_lag_1h", "temp_lag_24h",
    "precipitation", "is_day", "is_holiday", "is_weekend",
    "hour", "day_of_week", "month", "season",
    "lag_1h", "lag_24h", "rollmean_24h", "y_next",
]

# Model inputs in training order.
MODEL_FEATURES = [
    "lag_1h", "lag_24h", "rollmean_24h",
    "hour", "day_of_week", "month",
    "apparent_temperature_norm", "temp_lag_1h", "temp_lag_24h",
    "precipitation",
    "is_day", "is_weekend", "is_holiday",
    "region_id",
]
INTEGER_FEATURES = ["hour", "day_of_week", "month", "is_day", "is_weekend", "is_holiday", "region_id"]

# Month -> season, southern hemisphere.
SOUTHERN_SEASONS = {
    "Summer": [12, 1, 2],
    "Autumn": [3, 4, 5],
    "Winter": [6, 7, 8],
    "Spring": [9, 10, 11],
}

# Normalization floors.
GLOBAL_FLOOR = 1e-9
ENTITY_FLOOR = 1e-6

TARGET = "y_next"
ROLLING_ROWS = 24
