"""Query plans: the star-schema benchmark, the synthetic query and conjunctive scans."""
