"""Fixed thresholds of the capture pipeline (metres, counts, ratios)."""

# Fixed values.
HORIZONTAL_NY = 0.9
VERTICAL_NY = 0.15
FLOOR_BIN = 0.01
FLOOR_SHARE = 0.25
LAYER_HALF_WIDTH = 0.03
CEILING_MIN_HEIGHT = 1.9
CEILING_MIN_POINTS = 2000
ANGLE_BINS = 360
FAN_BINS = 180
SNAP_SEARCH = 0.35
SNAP_BIN = 0.005
OPENING_BIN = 0.02
OPENING_PLANE = 0.08
OPENING_WIDTHS = (0.45, 2.4)
PROBE_DEPTHS = (0.3, 0.5, 0.8)
BEYOND_DEPTHS = (0.25, 0.4, 0.6)
AXIS_COS = 0.94
RESIDUAL_GATE = 0.09
SHIFT_LIMIT = 0.08
OPENING_PASS = 0.85
MAD_SCALE = 1.4826
Z95 = 1.96
