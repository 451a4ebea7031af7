"""cuegrid.operators"""
