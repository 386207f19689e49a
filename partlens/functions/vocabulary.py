"""Names the store, the search and the readers share: keys, requirements, categories. Fixed values, as plain text."""

from __future__ import annotations

#: Stored key, the name it is read under, which value counts first.
KEYS = {
    key: (name, first)
    for key, name, first in (
        line.split()
        for line in """
        gain_db gain_db min
        nf_db noise_nf_db max
        p1db_dbm p1db_dbm min
        oip3_dbm oip3_dbm min
        insertion_loss_db insertion_loss_db max
        isolation_db isolation_db min
        vswr vswr max
        attenuation_db attenuation_db typ
        power_w power_w min
        psat_dbm psat_dbm min
        conversion_loss_db conversion_loss_db max
        switching_time_ns switching_time_ns max
        no_of_ways no_of_ways typ
        ports ports typ
        tid_krad tid_krad typ
        sel_mev sel_mev typ
        """.strip().splitlines()
    )
}
#: Other spellings of stored keys.
RENAMED = {"switching_speed_ns": "switching_time_ns", "switch_speed_ns": "switching_time_ns", "switching_time": "switching_time_ns"}
#: Keys whose text is read as it is, the last one stored.
TEXTS = "connector mount_type technology space space_variant package qual_level ti_suffix orderable source_category".split()
#: Texts that are cleared of repeated parts.
LISTED = "industry_application configuration subtype connector technology".split()

_LOW, _HIGH = ("min", "low"), ("max", "high")


def edges() -> dict[str, list[tuple[str, str]]]:
    """Keys that hold an edge of a band: the band's name and lo, hi or both. RF and LO edges stated together are edges of both ports."""
    found: dict[str, list[tuple[str, str]]] = {}
    for port in ("rf", "lo", "if"):
        band = f"{port}_freq_ghz"
        found |= {f"{port}_freq_{x}": [(band, "lo")] for x in _LOW} | {f"{port}_freq_{x}": [(band, "hi")] for x in _HIGH} | {f"{port}_freq_{x}": [(band, "both")] for x in ("ghz", "range")}
    for words, edge in ((_LOW, "lo"), (_HIGH, "hi")):
        found |= {f"rf_lo_freq_{x}": [("rf_freq_ghz", edge), ("lo_freq_ghz", edge)] for x in words} | {f"lo_power_dbm_{x}": [("lo_power_dbm", edge)] for x in words}
    return found


#: Declared specifications: key, the requirement's name, how they compare, the criterion's name, tolerance.
SPECS = [
    (key, wanted, kind, criterion, float(tolerance))
    for key, wanted, kind, criterion, tolerance in (
        line.split()
        for line in """
        nf_db nf_db_max max nf 0
        p1db_dbm p1db_dbm_min min p1db 0
        oip3_dbm oip3_dbm_min min oip3 0
        psat_dbm psat_dbm_min min psat 0
        throw_config throw_config text thr 0
        isolation_db isolation_db_min min isol 0
        conversion_loss_db conversion_loss_db_max max cl 0
        coupling_db coupling_db approx cpl 1
        switching_time_ns switching_time_ns_max max tsw 0
        power_w power_w_min min pwr 0
        p1db_input_dbm p1db_input_dbm_min min p1db_inp 0
        reverse_isolation_db reverse_isolation_db_min min reverse_ 0
        thermal_resistance_cw thermal_resistance_cw_max max thermal_ 0
        power_dissipation_w power_dissipation_w_max max power_di 0
        lo_power_dbm lo_power_dbm approx lo_power 0
        isolation_lo_rf_db isolation_lo_rf_db_min min isolatio 0
        isolation_lo_if_db isolation_lo_if_db_min min isolatio 0
        isolation_rf_if_db isolation_rf_if_db_min min isolatio 0
        rf_power_dbm rf_power_dbm_min min rf_power 0
        if_power_dbm if_power_dbm_min min if_power 0
        rf_freq_min_ghz rf_freq_min_ghz_max max rf_freq_ 0
        rf_freq_max_ghz rf_freq_max_ghz_min min rf_freq_ 0
        lo_freq_min_ghz lo_freq_min_ghz_max max lo_freq_ 0
        lo_freq_max_ghz lo_freq_max_ghz_min min lo_freq_ 0
        if_freq_min_ghz if_freq_min_ghz_max max if_freq_ 0
        if_freq_max_ghz if_freq_max_ghz_min min if_freq_ 0
        directivity_db directivity_db_min min directiv 0
        mainline_loss_db mainline_loss_db_max max mainline 0
        coupled_vswr coupled_vswr_max max coupled_ 0
        ways ways approx ways 0
        phase_balance_deg phase_balance_deg_max max phase_ba 0
        internal_dissipation_w internal_dissipation_w_max max internal 0
        phase_range_deg phase_range_deg_min min phase_ra 0
        phase_resolution_deg phase_resolution_deg_max max phase_re 0
        phase_error_rms_deg phase_error_rms_deg_max max phase_er 0
        control_voltage_v control_voltage_v approx control_ 0
        group_delay_ns group_delay_ns_max max group_de 0
        stopband_rejection_db stopband_rejection_db_min min stopband 0
        passband_return_loss_db passband_return_loss_db_min min passband 0
        hot_switching_power_w hot_switching_power_w_min min hot_swit 0
        attenuation_step_db attenuation_step_db_max max attenuat 0
        attenuation_range_db attenuation_range_db_min min attenuat 0
        storage_temp_c storage_temp_c approx storage_ 0
        junction_temp_c junction_temp_c_min min junction 0
        forward_current_ma forward_current_ma_min min forward_ 0
        reverse_voltage_v reverse_voltage_v_min min reverse_ 0
        soldering_temp_c soldering_temp_c_min min solderin 0
        """.strip().splitlines()
    )
]
#: Specifications that each category asks for, in order.
ASKED = {
    "amplifier": "nf_db p1db_dbm oip3_dbm psat_dbm reverse_isolation_db thermal_resistance_cw power_dissipation_w p1db_input_dbm",
    "attenuator": "power_w attenuation_step_db attenuation_range_db",
    "coupler": "coupling_db isolation_db directivity_db mainline_loss_db coupled_vswr",
    "divider": "isolation_db ways phase_balance_deg internal_dissipation_w",
    "filter": "group_delay_ns stopband_rejection_db passband_return_loss_db",
    "limiter": "power_w",
    "mixer": "conversion_loss_db isolation_db oip3_dbm lo_power_dbm rf_power_dbm if_power_dbm isolation_lo_rf_db isolation_lo_if_db isolation_rf_if_db"
    " rf_freq_min_ghz rf_freq_max_ghz lo_freq_min_ghz lo_freq_max_ghz if_freq_min_ghz if_freq_max_ghz",
    "phase_shifter": "phase_range_deg phase_resolution_deg phase_error_rms_deg control_voltage_v",
    "switch": "isolation_db switching_time_ns hot_switching_power_w",
    "termination": "power_w",
}
#: Fields of a category's form before and after its specifications.
FIELDS = {"amplifier": "freq gain_db_min noise_k_max temp_k", "attenuator": "freq attenuation_db", "coupler": "freq ports"}
TAIL = "connector package impedance space max_lead_weeks"

#: Subcategories: category, key, label, the words that name it.
SUBCATEGORIES = [
    tuple(x.strip() for x in line.split("|"))
    for line in """
    amplifier | lna | LNA — low noise | low noise amplifier, lna
    amplifier | pa | PA — power | power amplifier, pa
    amplifier | hpa | HPA — high power | high power amplifier, hpa
    amplifier | driver | Driver / gain block | driver amplifier, gain block
    amplifier | vga | VGA — variable gain | variable gain amplifier, vga
    amplifier | if | IF amplifier | if amplifier
    amplifier | buffer | Buffer | buffer amplifier
    amplifier | log | Log / limiting | logarithmic amplifier, limiting amplifier
    attenuator | fixed | Fixed | fixed attenuator
    attenuator | step | Step / programmable (DSA) | digital step attenuator, step attenuator
    attenuator | vva | Voltage-variable (VVA) | voltage variable attenuator, vva
    attenuator | minloss | Minimum-loss pad | min-loss pad, minimum loss pad
    attenuator | matching | Impedance matching pad | impedance matching pad, matching pad
    coupler | directional | Directional | directional coupler
    coupler | dual | Dual-directional | dual directional coupler
    coupler | bidirectional | Bi-directional | bi-directional coupler
    coupler | hybrid90 | 90° hybrid (quadrature) | 90 degree hybrid, quadrature hybrid
    coupler | hybrid180 | 180° hybrid (rat-race) | 180 degree hybrid, rat-race coupler
    divider | wilkinson | Wilkinson | wilkinson power divider
    divider | resistive | Resistive | resistive power divider
    divider | reactive | Reactive | reactive power divider
    divider | hybrid | Hybrid | hybrid power divider
    divider | 2way | 2-way | 2 way power divider
    divider | 4way | 4-way | 4 way power divider
    divider | 8way | 8-way | 8 way power divider
    divider | combiner | Combiner | power combiner
    filter | lpf | LPF — low-pass | low pass filter, lowpass filter, lpf
    filter | hpf | HPF — high-pass | high pass filter, highpass filter, hpf
    filter | bpf | BPF — band-pass | band pass filter, bandpass filter, bpf
    filter | bsf | BSF — band-stop / notch | band stop filter, bandstop filter, band reject filter, band-reject filter, notch filter, notch, bsf
    filter | diplexer | Diplexer | diplexer
    filter | duplexer | Duplexer | duplexer
    filter | cavity | Cavity | cavity filter
    filter | ceramic | Ceramic | ceramic filter
    filter | tunable | Tunable | tunable filter
    limiter | pin | PIN diode | pin diode limiter
    limiter | diode | Diode | diode limiter
    limiter | receiver | Receiver protector | receiver protector
    limiter | prelimiter | Pre-limiter | pre-limiter
    mixer | double | Double-balanced | double balanced mixer
    mixer | triple | Triple-balanced | triple balanced mixer
    mixer | single | Single-balanced | single balanced mixer
    mixer | iq | IQ / image-reject | iq mixer, image reject mixer
    mixer | up | Upconverter | upconverter
    mixer | down | Downconverter | downconverter
    mixer | harmonic | Harmonic | harmonic mixer
    mixer | active | Active | active mixer
    phase_shifter | analog | Analog | analog phase shifter
    phase_shifter | digital | Digital | digital phase shifter
    phase_shifter | voltage | Voltage-controlled | voltage controlled phase shifter
    phase_shifter | reflection | Hybrid / reflection | reflection phase shifter
    phase_shifter | vector | Vector modulator | vector modulator
    switch | absorptive | Absorptive | absorptive switch, terminated switch, non-reflective switch, 50 ohm terminated
    switch | reflective | Reflective | reflective switch, shunt switch
    termination | coaxial | Coaxial load | coaxial termination
    termination | chip | Chip / SMT | chip termination
    termination | highpower | High-power | high power termination
    termination | feedthrough | Feedthrough | feedthrough termination
    balun | balun | Balun (unbal→bal) | balun
    balun | transformer | RF transformer | rf transformer, impedance transformer
    balun | active | Active balun | active balun
    balun | passive | Passive balun | passive balun
    """.strip().splitlines()
]
#: Words for categories; where a category was named twice, the later words.
CATEGORIES = {
    name.strip(): [w.strip() for w in words.split(",")]
    for name, words in (
        line.split("|")
        for line in """
        amplifier | amplifier, amp, gain block, power amplifier, high power amplifier, lna, low noise amplifier, low-noise amplifier, driver amplifier, buffer amplifier, variable gain amplifier, if amplifier, limiting amplifier, logarithmic amplifier, log amplifier
        attenuator | attenuator, atten, pad, fixed attenuator, variable attenuator, step attenuator, digital step attenuator, programmable attenuator, voltage variable attenuator, impedance matching pad, matching pad, min-loss pad, minimum loss pad
        termination | termination, terminator, load
        isolator | isolator, rf isolator
        circulator | circulator, rf circulator
        cable | cable, coax, coaxial, jumper, assembly
        connector | connector, adapter, adaptor
        feedthrough | feedthrough, feed-through, hermetic, bulkhead
        filter | filter, bandpass, lowpass, highpass, bpf, lpf, hpf
        mixer | mixer, frequency mixer
        coupler | coupler, directional coupler, hybrid, 90/180 degree hybrid
        divider | divider, splitter, combiner, power divider, power splitter, power splitters / combiners
        switch | switch, spdt, sp3t, sp4t, transfer switch
        dc_block | dc block, dc-block
        bias_tee | bias tee, bias-tee, bias tees
        detector | detector, power detector, rf detector, successive detection log video amplifier
        phase_shifter | phase shifter, phase shifters
        equalizer | equalizer, equaliser, gain equalizer, cable equalizer
        frequency_multiplier | frequency multiplier, frequency multipliers, multiplier, doubler, tripler
        limiter | limiter, limiters
        power_sensor | power sensor, power sensors
        power_detector | power detector, power detectors
        phase_detector | phase detector, phase detectors
        balun | balun, baluns, transformer, transformers, transformers / baluns
        modulator | modulator, demodulator, iq modulator, vector modulator, modulators & demodulators
        demodulator | demodulator, demodulators, iq demodulator
        oscillator | oscillator, vco, dro, ocxo, tcxo, xo, voltage controlled oscillator
        synthesizer | synthesizer, synthesiser, pll, pll synthesizer, frequency synthesizer
        mmic_die | mmic die, mmic die parts, bare die
        waveguide | waveguide, waveguides
        data_converter | data converter, adc, dac, analog to digital, digital to analog, a/d converter, d/a converter
        power | power management, regulator, ldo, dc-dc, dc/dc, voltage reference, pmic, point of load, power
        clock | clock, timing, clock and timing, clock generator, clock buffer, clock distribution
        sensor | sensor, temperature sensor, current sense
        interface | interface, transceiver ic, rs-485, rs-422, lvds, digital isolator, can transceiver
        beamformer | beamformer, beamforming, beam former
        transceiver | rf transceiver, transceiver, mxfe
        ic | integrated circuit, analog function, logic, asic
        multiplier | multiplier, frequency multiplier, doubler, tripler
        transistor | transistor, hemt, phemt, gan hemt, gaas phemt, rf transistor, ldmos
        diode | diode, pin diode, schottky diode, varactor, limiter diode
        op_amp | op amp, op-amp, operational amplifier, precision amplifier, instrumentation amplifier, difference amplifier, current sense amplifier, precision amplifiers
        """.strip().splitlines()
    )
}
#: Words for packages.
PACKAGES = {"connectorized": "connectorized, connectorised, coax, coaxial, connector", "smt": "smt, surface-mount, surface mount, surfacemount, drop-in, drop in, dropin, qfn, lga", "die": "die, bare-die, bare die, mmic, chip, wirebond, wire-bond", "flange": "flange, flange-mount, flange mount"}


def synonyms(category: str | None) -> list[str]:
    """The words for a category, else its own name."""
    return CATEGORIES.get(category, [category]) if category else []


def subcategories(category: str) -> list[tuple[str, str, list[str]]]:
    """key, label and words of a category's subcategories."""
    return [(key, label, [w.strip() for w in words.split(",")]) for of, key, label, words in SUBCATEGORIES if of == category]


def named_by(category: str, key: str) -> list[str]:
    return next((words for k, _, words in subcategories(category) if k == key), [])


def excluded_by(category: str, key: str) -> list[str]:
    """Words of the other subcategories that can't be taken for something else: several words, or five letters and more."""
    if not any(of == category for of, *_ in SUBCATEGORIES):
        return []
    own = named_by(category, key)
    return sorted({w for k, _, words in subcategories(category) if k != key for w in words if w not in own and (" " in w or len(w) >= 5)})


def fields(category: str) -> list[str]:
    """A category's form: its own fields, its specifications, what all have."""
    return [*FIELDS.get(category, "freq").split(), *ASKED.get(category, "").split(), *TAIL.split()]


def canonical(value: str | None, words: dict[str, list[str]]) -> str | None:
    """The name that a word stands for, first in order; an unknown word stands for itself."""
    if not value:
        return None
    v = value.strip().lower()
    return v if v in words else next((name for name, own in words.items() if v in own), v)


def category_of(value: str | None) -> str | None:
    return canonical(value, CATEGORIES)


def package_of(value: str | None) -> str | None:
    return canonical(value, {name: [w.strip() for w in own.split(",")] for name, own in PACKAGES.items()})


#: Spellings of the same manufacturer.
VENDORS = {
    spelling.strip(): name.strip()
    for name, spellings in (
        line.split("|")
        for line in """
        Mini-Circuits | mini circuits, minicircuits, mini-circuits, mini circuits ltd, scientific components
        MACOM | macom, m/a-com, ma-com, m a com, macom technology solutions, m/a-com technology solutions
        Analog Devices | analog devices, adi, analog devices inc, hittite, hittite microwave, linear technology, maxim integrated
        Qorvo | qorvo, qorvo inc, rfmd, triquint
        Marki Microwave | marki microwave, marki, marki microwave inc
        Teledyne | teledyne, teledyne microwave solutions, teledyne e2v, teledyne defence
        Texas Instruments | texas instruments, ti, texas instruments inc
        Skyworks | skyworks, skyworks solutions, skyworks solutions inc
        Planar Monolithics | planar monolithics, planar monolithics (pmi), pmi, planar monolithics industries
        Crane Aerospace | crane aerospace, crane aerospace & electronics, crane aerospace and electronics, crane
        RF-Lambda | rf-lambda, rf lambda, rflambda
        Mercury Systems | mercury systems, mercury
        Wainwright Instruments | wainwright instruments, wainwright
        """.strip().splitlines()
    )
    for spelling in spellings.split(",")
}
#: Words that end a company's name.
COMPANY = "inc incorporated corp corporation ltd llc gmbh co".split()
