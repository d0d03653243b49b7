from .numeric import greatest_or_null, least_or_null, percent_change, round_binary, round_scaled, safe_div, to_number
from .text import coin_name, parse_matrix, parse_vector
from .timegrid import bar_close, epoch_seconds, step_times

__all__ = [
    "bar_close", "coin_name", "epoch_seconds", "greatest_or_null", "least_or_null", "parse_matrix",
    "parse_vector", "percent_change", "round_binary", "round_scaled", "safe_div", "step_times", "to_number",
]
