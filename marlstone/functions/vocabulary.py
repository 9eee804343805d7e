"""Stations, symbols and word lists that results depend on."""

from __future__ import annotations

# city, country, station, name, latitude, longitude, time zone, unit
STATIONS = [
    ("New York", "US", "KLGA", "LaGuardia Airport", 40.7769, -73.8740, "America/New_York", "F"),
    ("Miami", "US", "KMIA", "Miami Intl Airport", 25.7959, -80.2870, "America/New_York", "F"),
    ("Chicago", "US", "KORD", "OHare Airport", 41.9742, -87.9073, "America/Chicago", "F"),
    ("Los Angeles", "US", "KLAX", "LAX Airport", 33.9425, -118.4081, "America/Los_Angeles", "F"),
    ("Houston", "US", "KIAH", "Houston Intercontinental", 29.9902, -95.3368, "America/Chicago", "F"),
    ("Dallas", "US", "KDFW", "Dallas Fort Worth", 32.8998, -97.0403, "America/Chicago", "F"),
    ("Phoenix", "US", "KPHX", "Phoenix Sky Harbor", 33.4373, -112.0078, "America/Phoenix", "F"),
    ("Seattle", "US", "KSEA", "Seattle Tacoma Airport", 47.4502, -122.3088, "America/Los_Angeles", "F"),
    ("Atlanta", "US", "KATL", "Hartsfield Atlanta", 33.6407, -84.4277, "America/New_York", "F"),
    ("Boston", "US", "KBOS", "Logan International", 42.3656, -71.0096, "America/New_York", "F"),
    ("London", "UK", "EGLC", "London City Airport", 51.5048, 0.0495, "Europe/London", "C"),
    ("Paris", "FR", "LFPO", "Paris Orly Airport", 48.7262, 2.3652, "Europe/Paris", "C"),
    ("Berlin", "DE", "EDDB", "Berlin Brandenburg", 52.3667, 13.5033, "Europe/Berlin", "C"),
    ("Amsterdam", "NL", "EHAM", "Schiphol Airport", 52.3105, 4.7683, "Europe/Amsterdam", "C"),
    ("Madrid", "ES", "LEMD", "Barajas Airport", 40.4983, -3.5676, "Europe/Madrid", "C"),
    ("Hong Kong", "HK", "VHHH", "HK Intl Airport", 22.3089, 113.9149, "Asia/Hong_Kong", "C"),
    ("Tokyo", "JP", "RJTT", "Tokyo Haneda Airport", 35.5533, 139.7811, "Asia/Tokyo", "C"),
    ("Singapore", "SG", "WSSS", "Changi Airport", 1.3644, 103.9915, "Asia/Singapore", "C"),
    ("Sydney", "AU", "YSSY", "Sydney Kingsford Smith", -33.9461, 151.1772, "Australia/Sydney", "C"),
    ("Dubai", "AE", "OMDB", "Dubai International", 25.2528, 55.3644, "Asia/Dubai", "C"),
]
# names of these cities in questions; of others the city and the station id
CITY_ALIASES = {
    "new york": ["new york", "nyc", "jfk", "laguardia", "klga"],
    "los angeles": ["los angeles", "l.a.", "lax", "klax"],
    "hong kong": ["hong kong", "hk", "vhhh"],
    "chicago": ["chicago", "kord", "o'hare", "ohare"],
}
WEATHER_KEYWORDS = [
    "temperature", "rain", "rainfall", "precipitation", "snow", "snowfall", "thunder", "storm", "humid", "wind", "weather", "forecast", "high temp",
    "low temp", "degrees", "celsius", "fahrenheit", "inches", "heat", "cold", "warm", "hot", "fog", "hail", "lightning", "freeze",
]
# outcome, label, words of its markets
OUTCOMES = [
    ("hot", "HOT (>90F/32C)", ["temperature", "temp", "degrees", "celsius", "fahrenheit"]),
    ("rain", "RAIN (>0.5in)", ["rain", "precipitation", "rainfall"]),
    ("snow", "SNOW", ["snow", "snowfall"]),
    ("storm", "STORM", ["thunder", "storm", "lightning"]),
]
YES_IS_COLD = "or below|or lower|at most|below|under"
YES_IS_RAIN = "will it rain|will there be rain|rain.*yes|precipitation.*occur"
YES_IS_DRY = "no rain|dry|without rain"
# the first that matches counts
ECONOMY_TAGS = [
    ("cpi", ["cpi", "inflation", "consumer price"]),
    ("jobs", ["unemployment", "jobs", "nonfarm", "payroll"]),
    ("fed", ["fed", "federal reserve", "interest rate", "rate cut", "rate hike"]),
    ("gdp", ["gdp", "recession"]),
]
SYMBOLS = [("BTC", ["bitcoin", "btc"]), ("ETH", ["ethereum", "eth"]), ("SOL", ["solana", "sol"]), ("XRP", ["xrp", "ripple"])]
SYMBOLS_V1 = SYMBOLS[:3]
RELATION_WORDS = ["above", "below", "reach", "hit", "exceed"]
RELATION_WORDS_V1 = ["above", "below", "price", "reach"]
ABOVE, BELOW = "(?i)above|over|exceed|higher|more than", "(?i)below|under|lower|less than"
TOPICS = ["bitcoin|btc", "ethereum|eth", "fed|federal reserve|interest rate", "inflation|cpi"]
SETTINGS = [("paper_balance", "1000"), ("paper_enabled", "true"), ("live_enabled", "false"), ("min_edge", "1.5"), ("max_position", "50"), ("scan_active", "true")]
