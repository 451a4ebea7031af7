"""cuegrid.streaming"""
