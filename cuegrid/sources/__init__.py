"""cuegrid.sources"""
