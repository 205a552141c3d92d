"""Plans of several operators: the delay campaign, benchmark scoring, nested cross-validation."""
