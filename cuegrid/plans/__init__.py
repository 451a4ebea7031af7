"""cuegrid.plans"""
