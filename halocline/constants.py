"""Physical constants, label tables and boxes the results depend on."""

# Physics.
RHO_WATER = 1025.0
HEAT_CAPACITY = 3985.0
DRAG = 1.3e-3
RHO_AIR = 1.225
OMEGA = 7.2921e-5
GRAVITY = 9.81
MIN_CORIOLIS = 1e-6
MLD_DELTA = 0.03
MLD_MAX = 2000.0
THERMOCLINE_MIN_PRES = 10.0
HEAT_CONTENT_MAX_PRES = 700.0
SURFACE_PRES = 20.0
UPPER_PRES = 200.0
QNET_RANGE = (-800.0, 600.0)
DENSITY_RANGE = (1000.0, 1060.0)
SST_FALLBACK_MEAN = 28.0

# Sensor accuracies and reference uncertainties.
TEMP_ERROR = 0.002
PSAL_ERROR = 0.010
DENSITY_ERROR = ((0.2 * TEMP_ERROR) ** 2 + (0.8 * PSAL_ERROR) ** 2) ** 0.5
MLD_ERROR = DENSITY_ERROR / 0.01
OHC_ERROR = RHO_WATER * HEAT_CAPACITY * TEMP_ERROR * HEAT_CONTENT_MAX_PRES
SST_INSTRUMENT_ERROR = 0.30
SST_BLENDING_ERROR = 0.10
QNET_ERROR = 15.0
WIND_ERROR = 0.5
SLA_ERROR = 0.02
SLA_CONFIDENCE = 0.95
SST_NOISE = 0.31

# Study region and period.
STUDY_LAT = (-40.0, 30.0)
STUDY_LON = (20.0, 120.0)
PROFILE_TIME_VALID = ("2015-01-01", "2027-01-01")

# Overlapping inclusive boxes (name, lat_min, lat_max, lon_min, lon_max).
BASIN_BOXES = [
    ("Arabian Sea", 5.0, 25.0, 55.0, 80.0),
    ("Bay of Bengal", 5.0, 25.0, 80.0, 100.0),
    ("Equatorial IO", -5.0, 5.0, 45.0, 100.0),
    ("Southern IO", -40.0, -15.0, 40.0, 100.0),
    ("Western IO", -15.0, 15.0, 40.0, 65.0),
    ("Eastern IO", -15.0, 15.0, 95.0, 120.0),
]

# Labels.
HEATWAVE_CATEGORY_LABELS = {0: "None", 1: "Moderate", 2: "Strong", 3: "Severe", 4: "Extreme"}
TREND_KEYS = {"SST anomaly": "sst", "OHC_700m": "ohc_700m", "MLD": "mld", "Qnet": "qnet"}
MONTH_NAMES = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

# Accepted range per variable.
RANGE_BOUNDS = {
    "wind_speed": (0.0, 80.0),
    "tau_x": (-10.0, 10.0),
    "tau_y": (-10.0, 10.0),
    "ekman_x": (-500.0, 500.0),
    "ekman_y": (-500.0, 500.0),
    "qnet": (-800.0, 600.0),
    "sst": (-2.0, 40.0),
    "sst_anomaly": (-15.0, 15.0),
    "mld": (0.0, 2000.0),
    "thermocline": (5.0, 2000.0),
    "ohc_700m": (0.0, 8e10),
    "sst_argo": (-2.0, 40.0),
}
