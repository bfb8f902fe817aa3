"""Fixed values of the cost model, the spatial tests and the tag tables.

They must be these for right results, so they stand here once and are pinned by a test.
"""

# Cost model (seconds, metres, degrees, factors).
SIGNAL_S, CROSSING_S, TURN_S, LEFT_FACTOR, TURN_DEGREES, MERGE_M = 30.0, 2.0, 10.0, 1.5, 40.0, 25.0
SLOW_FACTOR, NETWORK_BONUS, BARRIER_S = 0.65, 0.9, 4.0
GRADE_FACTORS = (1.0, 0.8, 0.65, 0.55)
CLIMB_S, DESCENT_S = 2.0, 0.4
SHARP_DEGREES = 115.0
DEFAULT_KMH = 18.0

# Search preferences.
SIDEPATH_TASTE = 8.0
TRAFFIC_EXPOSURE = (0.0, 0.25, 0.6, 1.0, 1.4)
WINTER_SHARE = (0.0, 0.6, 1.0)
LEAST_MULTIPLIER = 1e-3
TASTES = ("turn", "signal", "unpaved", "shared", "traffic", "sidepath", "network", "hill", "barrier", "lit", "winter")

# Alternatives.
ALTERNATIVE_RATIO, ALTERNATIVE_OVERLAP, ALTERNATIVE_PENALTY, ALTERNATIVES = 1.3, 0.70, 1.6, 3

# Bits.
DEDICATED, SIDEPATH, NETWORK = 1, 2, 4
FORWARD, BACKWARD = 1, 2
UNPAVED, SHARED = 1, 2
PLAIN, CROSSING, SIGNAL, ISLAND_SIGNAL = 0, 1, 2, 3

# Spatial tests (metres, degrees).
METRES_LON, METRES_LAT = 111320.0, 110540.0
CUTS_DEGREES, SIGNAL_REACH, SIGNAL_MERGE = 45.0, 25.0, 30.0
REGISTER_NEAR, REGISTER_FAR, WALK_M = 40.0, 80.0, 240.0
PARALLEL_M, PARALLEL_DEGREES, PARALLEL_SHARE, PARALLEL_STEP = 20.0, 30.0, 0.7, 25.0
BOUNDS, BOUNDS_MARGIN = (24.40, 60.05, 25.40, 60.45), 0.15
CLIMB_STEP, CLIMB_THRESHOLD = 25.0, 2.0
WINTER_M, WINTER_DEGREES, WINTER_STEP, WINTER_SHARE_MIN = 14.0, 35.0, 10.0, 0.4
PLACE_CONTEXT, POINTS_PER_NAME, SEARCH_LIMIT, SEARCH_LEAST, PREFIX_HITS = 250.0, 5, 7, 2, 200
SMOOTH_M, STUB_M, STEP_MERGE = 100.0, 8.0, 25.0

# Tag tables.
RIDEABLE = ("cycleway", "path", "residential", "living_street", "service", "tertiary", "secondary", "primary", "unclassified", "track")
WALKWAYS, WALKWAY_BICYCLE = ("footway", "pedestrian"), ("yes", "designated")
ONEWAY_YES, ONEWAY_BACK = ("yes", "true", "1"), ("-1", "reverse")
CYCLEWAY_KEYS = ("cycleway", "cycleway:right", "cycleway:left", "cycleway:both")
SIDEPATH_VALUES = ("track", "opposite_track", "separate", "sidepath")
SLOW_SURFACES = ("gravel", "fine_gravel", "ground", "dirt", "earth", "grass", "sand", "mud", "wood", "pebblestone", "unpaved", "cobblestone", "sett", "compacted")
TRAFFIC_CLASS = {"cycleway": 0, "path": 0, "track": 0, "footway": 0, "pedestrian": 0, "living_street": 1, "service": 1, "residential": 1, "unclassified": 2, "tertiary": 2, "secondary": 3, "primary": 4}
TRAFFIC_UNKNOWN = 2
GRADE = {"compacted": 1, "fine_gravel": 1, "gravel": 1, "pebblestone": 1, "cobblestone": 2, "sett": 2, "wood": 2, "ground": 3, "dirt": 3, "earth": 3, "grass": 3, "sand": 3, "mud": 3, "unpaved": 3}
SLOW_BARRIERS = ("bollard", "block", "chicane", "planter", "jersey_barrier")
STOP_BARRIERS = ("gate", "lift_gate", "swing_gate", "stile", "kissing_gate", "cycle_barrier", "turnstile", "full-height_turnstile")

# Places, most prominent first; rules in the order they are tried (no values: any).
PLACE_KINDS = ("city", "town", "suburb", "quarter", "neighbourhood", "village", "airport", "mall", "attraction", "venue", "sports", "park", "nature", "station", "school", "hospital", "hotel", "office", "shop", "service")
DISTRICTS = PLACE_KINDS[:6]
NAME_KEYS = ("name", "short_name", "alt_name", "loc_name", "official_name", "name:sv", "name:en")
POI_RULES = (
    ("airport", "aeroway", ("aerodrome", "terminal")),
    ("station", "railway", ("station", "halt")),
    ("station", "public_transport", ("station",)),
    ("mall", "shop", ("mall", "department_store")),
    ("attraction", "tourism", ("museum", "gallery", "attraction", "zoo", "theme_park", "viewpoint")),
    ("attraction", "historic", ()),
    ("venue", "amenity", ("theatre", "cinema", "library", "arts_centre", "community_centre", "place_of_worship", "marketplace", "townhall", "exhibition_centre", "conference_centre")),
    ("sports", "leisure", ("sports_centre", "stadium", "swimming_pool", "ice_rink", "fitness_centre", "sports_hall", "track")),
    ("park", "leisure", ("park", "garden", "nature_reserve", "playground", "pitch", "marina")),
    ("school", "amenity", ("university", "college", "school")),
    ("hospital", "amenity", ("hospital", "clinic", "doctors")),
    ("nature", "natural", ("beach", "island", "peak", "spring")),
    ("nature", "place", ("island", "islet", "peninsula", "archipelago")),
    ("hotel", "tourism", ("hotel", "hostel", "guest_house", "camp_site")),
    ("shop", "shop", ()),
    ("service", "amenity", ()),
    ("office", "office", ()),
)
KIND_LABELS = {
    "city": "Kaupunki", "town": "Kaupunki", "suburb": "Kaupunginosa", "quarter": "Kaupunginosa", "neighbourhood": "Alue",
    "village": "Kylä", "airport": "Lentoasema", "station": "Asema", "mall": "Kauppakeskus", "attraction": "Nähtävyys",
    "venue": "Kulttuuri", "sports": "Liikunta", "park": "Puisto", "school": "Oppilaitos", "hospital": "Terveys",
    "nature": "Luonto", "hotel": "Majoitus", "office": "Toimisto", "shop": "Kauppa", "service": "Palvelu",
}
DEFAULT_LABEL, DOOR_LABEL, STREET_LABEL, ROAD_LABEL = "Paikka", "Osoite", "Katu", "Tie"

# Letters of the profile token, and the range each number may have.
TASTE_CODES = {"turn": "t", "signal": "g", "unpaved": "u", "shared": "j", "traffic": "c", "sidepath": "d", "network": "n", "hill": "h", "barrier": "b", "lit": "v", "winter": "w"}
TASTE_RANGE = (0.05, 100.0)
COST_CODES = {"signal_delay_s": "S", "turn_penalty_s": "T", "turn_left_factor": "L", "crossing_delay_s": "C", "slow_speed_factor": "F", "climb_s_per_m": "H", "descent_credit_s_per_m": "D"}
COST_RANGES = {"signal_delay_s": (0.0, 90.0), "turn_penalty_s": (0.0, 40.0), "turn_left_factor": (1.0, 3.0), "crossing_delay_s": (0.0, 20.0), "slow_speed_factor": (0.3, 1.0), "climb_s_per_m": (0.0, 8.0), "descent_credit_s_per_m": (0.0, 4.0)}
SPEED_RANGE, LINK_SPEED_RANGE = (5.0, 45.0), (10.0, 28.0)

# The five stops of each preference, the standard stop, and the presets by stop.
STOPS = {
    "traffic": ((0.75, 1, 1.5, 3, 8), 1), "unpaved": ((0.9, 1, 1.3, 2, 4), 1), "shared": ((0.9, 1, 1.3, 2, 4), 1), "network": ((0.6, 0.9, 1, 1.3, 2), 1),
    "sidepath": ((1, 2, 4, 8, 20), 3), "hill": ((1, 2, 4, 8, 20), 0), "barrier": ((1, 1.5, 2, 3, 6), 0), "lit": ((0.8, 0.9, 1, 1, 1), 2),
    "winter": ((0.6, 0.8, 1, 1, 1), 2), "turn": ((1, 1.5, 2, 3, 5), 0), "signal": ((1, 1.5, 2, 4, 8), 0),
}
PRESETS = {"balanced": {}, "calm": {"traffic": 3, "network": 0, "shared": 2}, "simple": {"turn": 2, "signal": 1}, "paved": {"unpaved": 4}, "flat": {"hill": 3}, "winter": {"winter": 0, "lit": 1, "unpaved": 3}}
