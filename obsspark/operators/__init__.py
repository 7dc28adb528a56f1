"""DataFrame -> DataFrame operators.

lines        parsing, text and time filters, tail (W1), inheritance (W2)
rank         top-K (K1/K2) and summaries (G1/G2)
diagnostics  source failures (J4/J5/P23-P25), journal-user and window guards
inventory    registry (P14/S8/J3/A5/G7/P16) and pods (P11-P13/P15/P17/J2/G4/G6/A4)
events       event time, window and pod match (P20/P21/J1)
containers   container logs (B2: G3/W1/P6/P7/P4/J7/P26)
metrics      scrape targets and outcomes (P18/P19/P22/J6/J6b/G5)
access       principals, glob scopes, authorization (C1-C5/J8)
triage       error signatures and anomaly triage (G8/G9)
checks       A-type checks
"""
