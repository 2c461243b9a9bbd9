"""Column specification, thresholds and the fixed domain values.

Every operator takes a :class:`SensorSpec` so the same code runs on the
nine-sensor well fleet and on the one- or four-sensor test tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# ---------------------------------------------------------------------------
# These must equal the original application's for equal results.
# ---------------------------------------------------------------------------
SENSOR_COLS = (
    "pump_pressure_psi", "flow_rate_bpd", "vibration_mm_s", "temperature_f",
    "torque_ft_lbs", "motor_current_amp", "oil_viscosity_cp", "gas_oil_ratio", "rpm",
)
COUNTER_COLS = ("hours_since_last_maintenance", "cumulative_operating_hours")
ENGINEERED_COLS = (
    "pressure_rolling_mean", "pressure_rolling_std",
    "vibration_rolling_max", "temp_rolling_mean",
    "pressure_change_rate", "vibration_trend",
    "maintenance_age_ratio",
)
REQUIRED_COLS = (
    "record_id", "well_id", "timestamp", "depth_ft",
    *SENSOR_COLS,
    "hours_since_last_maintenance", "cumulative_operating_hours",
    "maintenance_required", "failure_type", "days_to_failure",
)
# (sensor, low, high, label)
SENSOR_RANGES = (
    ("pump_pressure_psi", 800.0, 1200.0, "Pump Pressure (PSI)"),
    ("flow_rate_bpd", 350.0, 550.0, "Flow Rate (barrels/day)"),
    ("vibration_mm_s", 0.0, 3.5, "Vibration Level (mm/s)"),
    ("temperature_f", 160.0, 210.0, "Equipment Temperature (°F)"),
    ("torque_ft_lbs", 2500.0, 3500.0, "Drill Torque (ft-lbs)"),
    ("motor_current_amp", 45.0, 75.0, "Motor Current (Amps)"),
    ("oil_viscosity_cp", 35.0, 55.0, "Oil Viscosity (cP)"),
    ("gas_oil_ratio", 400.0, 600.0, "Gas-Oil Ratio"),
    ("rpm", 70.0, 110.0, "Rotations Per Minute (RPM)"),
)
FAULT_TYPES = ("pump_failure", "vibration_fault", "thermal_overload", "pressure_spike", "motor_fault")
NO_FAULT = "none"

STATUS_ISSUE_CRITICAL = "Active {fault} — maintenance required today"
STATUS_ISSUE_MAINT = "Sensors suggest maintenance is overdue — inspect within 5 days"
STATUS_ISSUE_OVERDUE = "No service in {hours} hrs — routine inspection recommended"
STATUS_ISSUE_OK = "All sensors within normal operating range"

PRIORITY_ACTIONS = (
    ("Critical", "Dispatch crew immediately — active fault confirmed"),
    ("High", "Inspect within 5 days — sensors flagged for maintenance"),
    ("Medium", "Routine inspection overdue — schedule within 2 weeks"),
    ("Low", "No action needed — continue monitoring"),
)
PRIORITY_DAYS = (("High", 5.0), ("Medium", 14.0), ("Low", 30.0))
CRITICAL_DEFAULT_DAYS = 2.0

ALERT_MESSAGE = "Well {well}: Predicted failure in {days} days (confidence: {pct}%)"
ALERT_TYPE = "predicted_failure"
WELL_INSTALL_DATE = "2022-01-01"
WELL_LOCATION_PREFIX = "Field-"
DEFAULT_TECHNICIAN = "Unassigned"
SPLIT_SEED = 42
TEST_FRACTION = 0.2
# grade cut-offs: (minimum AUC, grade)
GRADES = ((0.95, "A+"), (0.90, "A"), (0.85, "B"))
# dashboard bands: (upper days bound, band) / (probability above, band) / (anomalies above, band)
DAYS_BANDS = ((3.0, "act_now"), (7.0, "schedule"))
DAYS_BAND_ELSE = "none_imminent"
RISK_BANDS = ((0.7, "high"), (0.4, "moderate"))
RISK_BAND_ELSE = "low"
ANOMALY_BANDS = ((10, "many"), (0, "some"))
ANOMALY_BAND_ELSE = "none"
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Thresholds:
    probability: float = 0.5          # predicted_failure = p >= this
    days_clip: tuple = (0.0, 30.0)    # days prediction clip
    alert_days: float = 7.0           # at-risk when predicted days <= this
    critical_days: float = 3.0        # alert severity critical when <= this
    overdue_hours: float = 650.0      # status WARNING when hours > this
    age_divisor_hours: float = 720.0  # maintenance_age_ratio
    regressor_horizon_days: float = 14.0
    label_horizon_days: float = 7.0   # maintenance_required horizon
    vibration_limit: float = 3.5      # KPI flag on average vibration
    workload_days: float = 30.0


@dataclass(frozen=True)
class SensorSpec:
    """Names of the columns a readings table carries."""

    entity: str = "well_id"
    time: str = "timestamp"          # timestamp (no zone)
    time_us: str = "t_us"            # epoch microseconds of ``time``; ordering + arithmetic
    record: str = "record_id"
    sensors: tuple = SENSOR_COLS
    counters: tuple = COUNTER_COLS
    depth: str = "depth_ft"
    label: str = "maintenance_required"
    fault: str = "failure_type"
    days: str = "days_to_failure"
    pressure: str = "pump_pressure_psi"
    vibration: str = "vibration_mm_s"
    temperature: str = "temperature_f"
    ranges: tuple = SENSOR_RANGES
    tiebreak: tuple = ()             # extra ordering columns after (time, record)
    thresholds: Thresholds = field(default_factory=Thresholds)

    @property
    def order_cols(self) -> tuple:
        return (self.time_us, self.record, *self.tiebreak)

    @property
    def impute_cols(self) -> tuple:
        """Columns the model/dashboard path imputes (sensors + counters)."""
        return (*self.sensors, *self.counters)

    @property
    def engineered(self) -> tuple:
        return ENGINEERED_COLS

    @property
    def features(self) -> tuple:
        """Feature vector order: sensors, counters, depth, engineered."""
        return (*self.sensors, *self.counters, self.depth, *ENGINEERED_COLS)

    def with_(self, **kw) -> "SensorSpec":
        return replace(self, **kw)


WELL_SPEC = SensorSpec()

# The ``events`` table seen as a one-well-per-user sensor fleet (see sources/adapters.py).
EVENTS_SPEC = SensorSpec(
    sensors=("value", "signal"),
    pressure="value",
    vibration="signal",
    temperature="value",
    ranges=(("value", 0.0, 100.0, "Event value"), ("signal", 10.0, 90.0, "Signal quality")),
    thresholds=Thresholds(overdue_hours=200.0, label_horizon_days=1.0, vibration_limit=50.0),
)

# ``lineitem`` seen as a four-sensor fleet, one machine per supplier.
LINEITEM_SPEC = SensorSpec(
    sensors=("l_quantity", "l_extendedprice", "l_discount", "l_tax"),
    pressure="l_extendedprice",
    vibration="l_quantity",
    temperature="l_discount",
    ranges=(
        ("l_quantity", 1.0, 50.0, "Quantity"),
        ("l_extendedprice", 900.0, 100000.0, "Extended price"),
        ("l_discount", 0.0, 0.1, "Discount"),
        ("l_tax", 0.0, 0.08, "Tax"),
    ),
    tiebreak=("l_partkey", "l_quantity", "l_extendedprice"),
)
