"""Multi-step plans: experiments, parameter grids, query catalogue."""
