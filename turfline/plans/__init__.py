"""The stage graph and its planner."""
