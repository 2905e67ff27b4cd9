"""Operators: functions from DataFrame(s) to a DataFrame.

- ``clean``     projections, filters, repairs (P01-P15)
- ``sampling``  exact reproducible samples (L01-L03)
- ``profile``   profiles, moments, exact quantiles, covariance (A01-A06, J01, J05, M06)
- ``fidelity``  histograms, JSD, box stats, hex density, embedding (A07-A09, A14-A16, J04, M02-M03, U02)
- ``synth``     batch plan and accounting, prompts, reply parsing, assembly, baseline (Y01-Y08, W01-W02, A17, S07)
- ``features``  session features from packet/connection tables (W03, K01-K07)
- ``detect``    first component, forest, vote, metrics, experiment (A04, A10-A13, J02-J03, F09, M01, M04-M05, U01)
- ``report``    report tables and load audit (S08, S09)
"""
