"""DataFrame operators (each takes and returns DataFrames; none collects rows to the driver).

ordering   W0 global running order, exact quantiles
features   A1, J1, J2, E2, A2, PF9
segments   M1-M4, A3, W6, J8
snapshots  IO5 frames, PF11, J10
experiment PF3, PF4, E1, E3, E6, A4-A6
outcomes   J11, E5
evaluate   W1-W5, U1, A8, A9
allocate   E7, PF5-PF8, J7, W7, A7, E8
lift       E4, W8
uplift     M5-M7
runs       M8, M9, A11
"""
