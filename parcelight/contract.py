"""The data contract: schemas, enumerations, intervals, transitions and rule parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

UNKNOWN = "unknown"
SMALL_SAMPLE = 30
LOW_COVERAGE = 0.8

def _schema(text: str) -> T.StructType:
    kinds = {"string": T.StringType(), "double": T.DoubleType(), "long": T.LongType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (f.split() for f in text.split(", "))])


ORDERS = _schema(
    "order_id string, created_at string, promised_delivery_time string, actual_delivery_time string, ordered_quantity double, delivered_quantity double, quantity_unit string, "
    "order_status string, raw_order_status string, warehouse_id string, carrier_id string, destination_region string, sales_channel string, source_index long"
)
WAREHOUSE_EVENTS = _schema("event_id string, order_id string, event_time string, event_code string, raw_status string, warehouse_id string, quantity double, quantity_unit string, source_system string, source_index long")
TRACKING_EVENTS = _schema(
    "tracking_event_id string, order_id string, shipment_id string, event_time string, event_code string, raw_status string, carrier_id string, location_code string, region_code string, "
    "exception_code string, sequence_number long, source_index long"
)

# Status enumerations and what they mean.
COMPLETED = ("delivered", "returned")
PENDING = ("created", "confirmed", "processing", "shipped", "unmapped")
WAREHOUSE_ANOMALIES = ("quality_check_failed",)
TRACKING_ANOMALIES = ("delivery_failed", "exception", "return_initiated", "returned")
DIMENSIONS = ("warehouse_id", "carrier_id", "destination_region", "sales_channel")

# The eight process intervals, in their declared order, as (start event, end event).
INTERVALS = {
    "order_to_pick": ("order_received", "picking_started"),
    "picking": ("picking_started", "picking_completed"),
    "pick_to_qc": ("picking_completed", "quality_check_started"),
    "quality_check": ("quality_check_started", "quality_check_completed"),
    "packing": ("packing_started", "packing_completed"),
    "ready_to_pickup": ("ready_to_ship", "carrier_picked_up"),
    "carrier_transit": ("carrier_picked_up", "delivered"),
    "hub_dwell": ("arrived_at_hub", "departed_hub"),
}
WAREHOUSE_INTERVALS = tuple(INTERVALS)[:5]

# Allowed changes of tracking state.
TRANSITIONS = {
    "shipment_created": ("carrier_picked_up",),
    "carrier_picked_up": ("origin_departed", "in_transit"),
    "origin_departed": ("in_transit", "arrived_at_hub"),
    "in_transit": ("in_transit", "arrived_at_hub", "arrived_at_destination_city"),
    "arrived_at_hub": ("departed_hub",),
    "departed_hub": ("in_transit", "arrived_at_hub", "arrived_at_destination_city"),
    "arrived_at_destination_city": ("out_for_delivery", "delivered"),
    "out_for_delivery": ("delivery_failed", "delivered"),
    "delivery_failed": ("out_for_delivery", "return_initiated"),
    "exception": ("in_transit", "out_for_delivery", "delivery_failed", "return_initiated"),
    "delivered": ("return_initiated", "returned"),
    "return_initiated": ("returned",),
}

SEVERITY_RANK = {"low": 1, "medium": 2, "high": 3, "critical": 4}


@dataclass(frozen=True)
class Parameter:
    value: float
    minimum: float
    maximum: float


@dataclass(frozen=True)
class Rule:
    rule_id: str
    category: str
    severity: str
    priority: int
    parameters: dict[str, Parameter]

    def __getitem__(self, name: str) -> float:
        return self.parameters[name].value


def _rule(rule_id: str, category: str, severity: str, priority: int, **p: tuple[float, float, float]) -> Rule:
    return Rule(rule_id, category, severity, priority, {k: Parameter(*v) for k, v in p.items()})


# Default parameters (value, least, most) of the diagnostic rules.
RULES = {
    r.rule_id: r
    for r in (
        _rule("FL-WH-001", "warehouse_delay", "medium", 70, order_to_pick_threshold_hours=(4, 0.25, 168), picking_threshold_hours=(2, 0.25, 168), pick_to_qc_threshold_hours=(2, 0.25, 168), quality_check_threshold_hours=(1.5, 0.25, 168), packing_threshold_hours=(2, 0.25, 168), baseline_multiplier=(1.5, 1.01, 10), minimum_baseline_sample=(10, 3, 10000)),
        _rule("FL-PU-001", "pickup_delay", "high", 85, threshold_hours=(12, 0.5, 336)),
        _rule("FL-LH-001", "linehaul_long_tail", "high", 82, threshold_hours=(72, 1, 1440), percentile=(0.9, 0.5, 0.99), minimum_baseline_sample=(30, 5, 10000)),
        _rule("FL-LM-001", "last_mile_backlog", "high", 84, station_dwell_threshold_hours=(24, 1, 720), delivery_attempt_threshold_hours=(12, 1, 336)),
        _rule("FL-CR-001", "carrier_relative", "medium", 55, minimum_sample=(30, 5, 10000), minimum_coverage=(0.8, 0.1, 1), otif_gap=(0.1, 0.01, 1), p90_ratio=(1.25, 1.01, 10)),
        _rule("FL-WC-001", "warehouse_congestion", "medium", 45, minimum_daily_orders=(10, 3, 10000), minimum_baseline_days=(3, 2, 365), volume_ratio=(1.25, 1.01, 10), duration_ratio=(1.2, 1.01, 10)),
        _rule("FL-TC-001", "time_concentration", "medium", 35, minimum_anomaly_orders=(10, 3, 10000), concentration_share=(0.5, 0.1, 1), minimum_distinct_dates=(3, 2, 365)),
        _rule("FL-DQ-001", "data_quality", "high", 100, long_interval_threshold_hours=(720, 24, 8760)),
    )
}


def resolve_rules(overrides: dict[str, dict[str, float]] | None = None) -> dict[str, Rule]:
    """RULES with the given parameter values; an unknown rule or name, or a value out of bounds, is an error."""
    out = dict(RULES)
    for rule_id, values in (overrides or {}).items():
        if rule_id not in out:
            raise ValueError(f"unknown rule {rule_id}")
        p = dict(out[rule_id].parameters)
        for name, v in values.items():
            if name not in p:
                raise ValueError(f"{rule_id} has no parameter {name}")
            if not p[name].minimum <= v <= p[name].maximum:
                raise ValueError(f"{rule_id}.{name}={v} is outside {p[name].minimum}..{p[name].maximum}")
            p[name] = Parameter(v, p[name].minimum, p[name].maximum)
        out[rule_id] = Rule(rule_id, out[rule_id].category, out[rule_id].severity, out[rule_id].priority, p)
    return out
