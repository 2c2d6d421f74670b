"""Lease reporting over a warehouse of versioned dimensions and facts."""
